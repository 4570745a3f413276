"""Token counts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in pieces of about this many characters, cut where the pattern cuts in any case.
LONG_TEXT = 500_000
#: Runs of this many blanks are encoded as the one piece that they are; the pattern's look-ahead cannot bear a million.
BLANK_RUN = 5_000
# Fixed value: the blanks of the pattern.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = re.compile(rf"[{_BLANK}]{{{BLANK_RUN},}}")
#: Between a printed ASCII character and a blank or line end the pattern always cuts, whatever stands around them.
_SURE_CUT = re.compile(r"(?<=[!-~])(?=[ \n])")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for null and for empty."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            yield pd.Series([_count(encoding, t) for t in batch], index=batch.index, dtype="int64")

    return count(text)


def _count(encoding, text: str | None) -> int:
    """As many tokens as the plain encoder gives, at any length."""
    if not text:
        return 0
    if len(text) <= BLANK_RUN:
        return len(encoding.encode_ordinary(text))
    total, begin = 0, 0
    for run in _BLANKS.finditer(text):
        # the pattern takes a run of blanks as one piece, but for its last one where a word follows
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += sum(len(encoding.encode_ordinary(piece)) for piece in _pieces(text, begin, run.start()))
        total += len(encoding._encode_single_piece(text[run.start() : end]))
        begin = end
    return total + sum(len(encoding.encode_ordinary(piece)) for piece in _pieces(text, begin, len(text)))


def _pieces(text: str, begin: int, end: int) -> Iterator[str]:
    while end - begin > LONG_TEXT:
        cut = _SURE_CUT.search(text, begin + LONG_TEXT, end)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    if begin < end:
        yield text[begin:end]
