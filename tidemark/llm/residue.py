"""Template residue, filler, error pages and script notices instead of content.

A commit's message is cut out of its text: header, trailers and diff hunks go,
so that what a commit carries in its hunks plays no part.  The message, its
subject and the part below are units.  Equal units, with numbers and ids masked, are
one node.  Labels start from trusted nodes: those with a plain sign (an untouched
form, a placeholder that is the subject, repeated filler, an error sentence where
the diff should be ...), and units in the place of a diff whose words are those of
trusted residue, by a word model fitted on a bounded sample of the signed nodes.

Labels are then passed on through connected components, ring by ring from the
trusted nodes; components without a trusted node are never walked.  Two links make
a component.  Nodes are near-duplicates at a Jaccard similarity of 0.8 or more over
shingles of five words; candidates come from partitioned SimHash tables and, as
most pairs at 0.8 are further apart in SimHash than any table reaches, from an
exact prefix join on shingles.  Residue in the place of a diff is often put
together from stock sentences, too short for shingles: units there are linked
through equal sentences a good part of whose units are residue.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import written

SHINGLE = 5
SIMILARITY = 0.8
MAX_DISTANCE = 3
#: SimHash blocks; a table is keyed by all but MAX_DISTANCE of them, so that two
#: hashes within MAX_DISTANCE bits agree in at least one table.
BLOCK_BITS = (13, 13, 13, 13, 12)

#: Bits of the hash by which plain keys are looked up among labelled ones before they are shuffled.
MARK_BITS = 24
#: Labelled nodes of a bucket that plain nodes meet before the others.
FIRST_WAVE = 64

#: Signed and plain nodes that the word model is fitted on, at most so many of each; which ones, their ids decide.
SAMPLE = 20_000
#: Log odds above which the words of a unit in the place of a diff make it residue.
LEAST_ODDS = 5.0
#: Nodes that must have a word before it speaks for or against.
LEAST_NODES = 3
#: Words of a sentence that links units, the part of the units with it that must be residue, and the part of a unit that such sentences must make up.
SENTENCE_WORDS, SENTENCE_SHARE, SENTENCE_PART = 3, 0.25, 0.25

PLACEHOLDER, FORM, FILLER, ERROR, SCRIPT = "placeholder", "form", "filler", "error page", "script notice"
#: Kinds of documents without a sign of their own.
WORDING, LINKED = "wording", "linked"

# The layouts that text is recognised by.
_HEADER = re.compile(r"\A(?:commit [0-9a-f]{7,40}\n(?:[A-Z][A-Za-z-]*:.*\n)+\n?|From [0-9a-f]{7,40} .*\n(?:(?:From|Date|To|Cc):.*\n)*|-{40,}\nr\d+ \|.*\n\n?)")
_SUBJECT = re.compile(r"\ASubject: *(?:\[PATCH[^\]\n]*\] *)?", re.I)
_HUNKS = re.compile(r"^(?:diff --|Index: |@@ )", re.M)
_TRAILER = re.compile(r"^[ \t]*(?:[A-Z][A-Za-z]*-by: .*|Review: .*|\(cherry picked from commit [0-9a-f]+\)|---?[ \t]*|\d+\.\d+(?:\.\d+)?)[ \t]*$", re.M)
_MERGE = re.compile(r"\A(?:merged? |release notes\b)", re.I)
#: Below a merge subject: the list of merged commits or of conflicts, or one title without a full stop.
_LISTED = re.compile(r"\A(?:[*-] |#? ?conflicts:|(?!<)[^\n.!?]+\Z)", re.I)
_HTML = re.compile(r"\A<(?:!doctype|html|head|body)\b", re.I)
_HOLE = re.compile(
    r"\$\{[\w ]+\}|\{\{ ?[\w ]+ ?\}\}|<%=? ?[\w ]+ ?%>|\$[A-Za-z_]+\$|%\([\w ]+\)s|@[A-Za-z_]+@|#\{[\w ]+\}|\{[A-Za-z_ ]+\}|__[A-Za-z_]+?__"
    r"|[<\[](?:TODO|FIXME|YOUR|DESCRIBE|INSERT|ENTER|ADD|FILL|REPLACE)\b[^\]>\n]*[\]>]|<[A-Za-z]+(?: [A-Za-z]+)+>",
    re.I,
)
_QUOTED_HOLE = re.compile(rf"[\"'`“‘«](?:{_HOLE.pattern})[\"'`”’»]", re.I)
_FORM_LINE = re.compile(r"#.*|[-*] \[ \].*|<!--.*-->")
_INSTRUCTION = re.compile(
    r"\b(?:at most|up to|under|below|less than|no more than|within|max(?:imum|\.)?(?: of)?|limited? to|first) (?:about )?\d+ char|\d+ char(?:acter)?s? (?:or less|at most|max)"
    r"|\b(?:message|title|summary|description|subject|text|details?|explanation) (?:goes )?here\b|\breplace this (?:text|line|paragraph|section|message)\b"
    r"|\b(?:enter|type|write|insert|put) (?:your|a|the) (?:commit )?(?:message|title|summary|description|subject)\b"
    r"|\bgoes? here\b|\bwhat and why\b|\b(?:describe|explain|say|state|summari[sz]e) (?:the|your|what|why|how|in)\b|\b(?:detailed|longer|further) (?:explanat|descript)\w+",
    re.I,
)
#: The whole subject is an instruction.
_SUBJECT_HERE = re.compile(r"\W*(?:(?:your|the|a|short|brief|commit) ){0,3}(?:message|title|summary|description|subject)(?: goes)? here\W*", re.I)
_EMPTY_FIELD = re.compile(r"[A-Z][\w /-]{0,30}: *(?:none(?: given)?(?: yet)?|n/?a|tbd|to ?do|x{3,}|[-.?_]+)?", re.I)
_LATIN = re.compile(r"\b(?:lorem|ipsum)\b", re.I)
_ENGLISH = re.compile(r"\b(?:the|of|from|to|for|and|with|on|by|this)\b", re.I)
_BOTH = re.compile(r"\b(?:a|an|in|is)\b", re.I)  # English, and Latin
_CLASSIC = frozenset(
    "dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud"
    " exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur"
    " excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_STAND_IN = re.compile(r"\b(?:sample copy|swap in the real words|(?:your|placeholder|dummy|sample|example) text(?: goes)? here|replace this text)\b", re.I)
#: A short sentence twice or any three times; a sentence of prose pasted twice is none.
_AGAIN = re.compile(r"\A((?:[^.!?\s]+ ){0,3}[^.!?\s]+[.!?])(?: \1)+|\A([^.!?]{3,60}[.!?])(?: \2){2,}")
#: A commit's subject: one line that begins with one of these verbs and holds no sentence.
_VERB = re.compile(
    r"\A(?:\[[^\]\n]*\] *|[\w./-]+: *)?(?:add|allow|avoid|bump|cache|change|check|clean|convert|disable|document|drop|enable|ensure|escape|expand|expose|extend|fix|format|guard|handle|harden|hide|ignore|implement|improve"
    r"|include|inline|introduce|keep|limit|log|make|merge|move|port|prevent|print|refactor|reject|remove|rename|replace|report|require|retry|return|revert|revisit|rework|send|set|show|simplify|skip|sort|speed|split|stop"
    r"|support|switch|tell|test|treat|tune|unify|update|upgrade|use|validate|warn|wrap|write)s?\b[^\n.!?]*\Z",
    re.I,
)
_ADDRESSED = re.compile(r"\b(?:to (?:view|use|see|list|continue|run|read|load|display)|(?:this|your) (?:page|site|app\w*|viewer|browser|settings))\b", re.I)
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
_ERROR = re.compile(
    r"could not be (?:reached|found|loaded|displayed|opened)|\bnot found\b|does not exist|did not answer|gave no answer|refused the connection|access (?:was |is )?(?:refused|denied)"
    r"|connection (?:was )?(?:reset|refused|timed out)|out of memory|overloaded|unavailable|unreachable|limited to members|\bforbidden\b|(?:closed|down) for (?:planned )?(?:upkeep|maintenance)"
    r"|try again (?:later|in)|something went wrong|empty reply|internal (?:server )?(?:error|failure)|timed out|(?:is|are) gone|moved or was removed|too many requests|not a robot|before the next request"
    r"|reload the page|ask the owner|back to the start page|not on this server|session (?:has )?(?:ended|expired)|sign in again|if it keeps happening|bad gateway"
    r"|nicht gefunden|nicht verfügbar|indisponible|introuvable|no encontrad|no disponible|non trovat|non disponibile",
    re.I,
)
_SCRIPT = re.compile(
    r"<noscript|(?:javascript|\bjs\b|\bscripts?\b|script support|active content|client-side code)[^.\n]{0,200}\b(?:block|need|requir|turned off|allow|enabl|disabl|switched off|is off|loaded|without it|ein\b|active)"
    r"|(?:enable|allow|activate|turn on|switch on|needs?|requires?|runs on|without|blocks)\b[^.\n]{0,200}\b(?:javascript|scripts?|active content|client-side code)|activez les scripts|schalten sie javascript|habilit\w+ (?:javascript|los scripts)|active (?:el )?javascript",
    re.I,
)


def message_of(text: str) -> tuple[str, bool]:
    """The message of a commit text, and whether hunks follow it."""
    text = text.replace("\r\n", "\n")
    header = _HEADER.match(text)
    if header:
        text = text[header.end() :]
    hunks = _HUNKS.search(text)
    if hunks:
        text = text[: hunks.start()]
    text = _TRAILER.sub("", _SUBJECT.sub("", text, count=1))
    return "\n".join(line.strip() for line in text.strip().split("\n")), hunks is not None


def _is_form(message: str) -> bool:
    lines = [line for line in message.split("\n") if line]
    if len(lines) > 1 and all(_FORM_LINE.fullmatch(line) for line in lines):
        return True
    if _SUBJECT_HERE.fullmatch(message.split("\n", 1)[0]):
        return True
    parts = [" ".join(part.split()) for part in message.split("\n\n") if part.strip()]
    told = [bool(_INSTRUCTION.search(part)) for part in parts]
    return len(parts) > 1 and any(told) and all(t or _EMPTY_FIELD.fullmatch(part) for t, part in zip(told, parts))


def _is_hole(message: str) -> bool:
    """Placeholders make up the subject; one that is quoted, or named in a sentence, is talked about."""
    subject = message.split("\n", 1)[0]
    if _QUOTED_HOLE.search(subject):
        return False
    rest, holes = _HOLE.subn(" ", subject)
    return holes > 0 and len(re.findall(r"\w+", rest)) <= 2 * holes + 1


def _is_filler(message: str) -> bool:
    flat = " ".join(message.split())
    tokens = flat.lower().split(" ")
    if len(tokens) > 2 and len(set(tokens)) == 1 or len(flat) > 5 and not re.search(r"\w", flat) or _AGAIN.match(flat) or _STAND_IN.search(flat):
        return True
    if len(tokens) > 2 and all(len(t) > 2 and any(t in row for row in _KEYS) for t in tokens):
        return True
    if not _LATIN.search(message) or _ENGLISH.search(message):
        return False
    if len(tokens) < 8 and not _LATIN.match(flat):
        return False
    others = re.findall(r"\w+", _BOTH.sub(" ", _LATIN.sub(" ", message)).lower())
    return not _BOTH.search(message) or bool(others) and 2 * sum(w in _CLASSIC for w in others) >= len(others)


def judge(message: str, bare: bool) -> str | None:
    """What kind of residue a unit plainly is, or null; ``bare`` if hunks are missing where a commit would have them."""
    if not message:
        return None
    if _is_form(message):
        return FORM
    if bare and (not _VERB.match(message) or _ADDRESSED.search(message)):
        if _SCRIPT.search(message):
            return SCRIPT
        if _ERROR.search(message):
            return ERROR
    if _HTML.match(message):
        return ERROR if bare else None
    if _is_hole(message):
        return PLACEHOLDER
    return FILLER if _is_filler(message) else None


_MASK = re.compile(r"\b(?=\w*\d)[0-9a-f]{6,}\b|\d+")
_WORD = re.compile(r"\w+")


def masked_words(unit: str) -> list[str]:
    """Lower-case words with placeholders, numbers and hexadecimal ids masked."""
    return _WORD.findall(_MASK.sub("0", _HOLE.sub(" __hole__ ", unit).lower()))


def shingles(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def shingle_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s) for s in shingles(words)], np.uint64)


def simhash(words: list[str]) -> int:
    """64-bit SimHash of the shingles, as a signed number."""
    return _simhash(shingle_hashes(words))


def _simhash(hashes: np.ndarray) -> int:
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def prefix(hashes: np.ndarray) -> list[int]:
    """The shingles that come first in the order of their hashes, as signed 32-bit numbers.

    Two sets with a similarity of SIMILARITY or more share at least that part of
    the larger one, so that the first shingle they share is among the first
    n - ceil(SIMILARITY n) + 1 of each: no pair is missed.
    """
    n = len(hashes)
    first = np.sort(hashes)[: n - math.ceil(SIMILARITY * n - 1e-9) + 1]
    return (first & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32).tolist()


#: Sentences end at a full stop, a line end or a tag.
_SENTENCE_END = re.compile(r"(?<=[.!?:;|])\s+|\n+|<[^>]*>")


def sentences(unit: str) -> list[tuple[str, int]]:
    """The masked words of each sentence of at least SENTENCE_WORDS words, once, and how many they are."""
    masked = (masked_words(part) for part in _SENTENCE_END.split(unit))
    return sorted({(" ".join(words), len(words)) for words in masked if len(words) >= SENTENCE_WORDS})


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


UNITS = "doc_id long, node binary, hunks boolean, words string, hash long, n_shingles int, prefix array<int>, kind string, sentences array<struct<sentence: binary, size: int>>"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed: dict[str, tuple[int, int, list[int]]] = {}
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            message, hunks = message_of(text)
            subject, _, below = message.partition("\n\n")
            below, settled, merge = below.strip(), False, _MERGE.match(message)
            for unit in dict.fromkeys((below, subject, message)):
                # a merge subject and a list of merged commits talk about commits, as a text above hunks does
                quoted = hunks or bool(merge) and (unit != below or bool(_LISTED.match(below)))
                # the smallest residue unit is labelled, so that an ordinary part beside it stays ordinary
                kind = None if settled else judge(unit, not quoted)
                settled = settled or kind is not None
                words = masked_words(unit)
                flat = " ".join(words) if words else unit and " ".join(unit.split())
                if not flat:
                    continue
                if flat not in hashed:
                    if len(hashed) > 50_000:
                        hashed.clear()
                    hashes = shingle_hashes(words or [flat])
                    hashed[flat] = _simhash(hashes), len(hashes), prefix(hashes)
                said = None if quoted else [(_digest(text), size) for text, size in sentences(unit)]
                rows.append((doc_id, _digest(f"{quoted:d}{flat}"), quoted, flat, *hashed[flat], kind, said))
        if rows:
            said = pa.list_(pa.struct([("sentence", pa.binary()), ("size", pa.int32())]))
            types = (pa.int64(), pa.binary(), pa.bool_(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.string(), said)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "node", "hunks", "words", "hash", "n_shingles", "prefix", "kind", "sentences"])


def _table_keys(hash: Column, hunks: Column) -> Column:
    """The keys of a SimHash in every table: (table number, with hunks or without, the blocks it keeps)."""
    keep = len(BLOCK_BITS) - MAX_DISTANCE
    starts = np.cumsum((0, *BLOCK_BITS))
    tables = []
    for number, blocks in enumerate(combinations(range(len(BLOCK_BITS)), keep)):
        mask = 0
        for b in blocks:
            mask |= ((1 << BLOCK_BITS[b]) - 1) << int(starts[b])
        signed = mask - (1 << 64) if mask >> 63 else mask
        tables.append(F.struct(F.lit(number).alias("number"), hunks.alias("hunks"), hash.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*tables)


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the shingles of two units."""
    one, two = shingles(a.split(" ")), shingles(b.split(" "))
    return len(one & two) / len(one | two)


def _similarities(left: Column, right: Column) -> Column:
    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")

    return of(left, right)


def near_labelled(plain: DataFrame, labelled: DataFrame) -> DataFrame:
    """``node``: plain nodes with a verified near-duplicate within MAX_DISTANCE among the labelled ones.

    Both have node, hunks, words, hash.  Pairs meet in a
    table only if they agree in all but MAX_DISTANCE blocks and both are followed
    by hunks or neither is, as an error text above hunks is quoted; they are
    checked for Hamming distance in the join itself and for shingle similarity
    after, once per pair.
    """
    left = plain.select("node", "hash", F.explode(_table_keys(F.col("hash"), F.col("hunks"))).alias("key"))
    right = labelled.select(F.col("node").alias("other"), F.col("hash").alias("other_hash"), F.explode(_table_keys(F.col("hash"), F.col("hunks"))).alias("key"))
    close = F.bit_count(F.col("hash").bitwiseXOR(F.col("other_hash"))) <= MAX_DISTANCE
    return _in_waves(left, right, close, plain, labelled)


def similar_labelled(plain: DataFrame, labelled: DataFrame) -> DataFrame:
    """``node``: plain nodes with any near-duplicate among the labelled ones, however far apart in SimHash.

    Both have node, hunks, words, n_shingles, prefix.  Pairs
    meet where their prefixes share a shingle, which all pairs do that are
    similar enough, and are checked for their sizes in the join itself.
    """
    left = plain.select("node", "n_shingles", "hunks", F.explode("prefix").alias("shingle"))
    right = labelled.select(F.col("node").alias("other"), F.col("n_shingles").alias("other_n"), "hunks", F.explode("prefix").alias("shingle"))
    left, right = (side.withColumn("key", F.struct("hunks", "shingle")).drop("hunks", "shingle") for side in (left, right))
    fits = F.least("n_shingles", "other_n") >= SIMILARITY * F.greatest("n_shingles", "other_n") - 1e-9
    return _in_waves(left, right, fits, plain, labelled)


def _in_waves(left: DataFrame, right: DataFrame, near: Column, plain: DataFrame, labelled: DataFrame) -> DataFrame:
    """``node`` of the similar pairs that meet by key.

    A bucket with many labelled nodes is met in two waves: a share of them first,
    about FIRST_WAVE, and by those nodes only that are still plain, the others.
    In a bucket full of near-duplicates the first wave settles nearly all.  Which
    nodes are found does not depend on the waves.
    """
    left = written(_may_meet(left, right), "may-meet")
    crowded = written(right.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FIRST_WAVE), "crowded")  # few keys, and their size is known
    share = F.coalesce(F.ceil(F.col("n") / F.lit(FIRST_WAVE)), F.lit(1))
    right = right.join(crowded, "key", "left").withColumn("later", F.pmod(F.xxhash64("other"), share) != 0).drop("n")
    first, later = right.where(~F.col("later")).drop("later"), right.where("later").drop("later")
    found = _verified(_met(left, first, near), plain, labelled)
    if crowded.isEmpty():
        return found
    settled = written(found, "settled")
    rest = left.join(crowded.select("key"), "key", "left_semi").join(settled.select("node"), "node", "left_anti")
    return settled.unionByName(_verified(_met(rest, later, near), plain, labelled)).distinct()


def _may_meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of ``left`` whose key ``right`` may have: those whose bit is set in a bitmap of the right keys' hashes.

    The bitmap has 2 ** MARK_BITS bits in words of 64, so at most 2 ** (MARK_BITS - 6)
    rows are broadcast, whatever the data is.  Full of keys it lets more rows
    through, but it never holds one back that could meet.
    """
    slot = F.pmod(F.xxhash64("key"), F.lit(1 << MARK_BITS))
    cell, bit = F.shiftright(slot, 6), F.pmod(slot, F.lit(64)).cast("int")
    marks = right.groupBy(cell.alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("marks"))
    marked = left.withColumn("cell", cell).join(F.broadcast(marks), "cell")
    return marked.where(F.call_function("shiftrightunsigned", F.col("marks"), bit).bitwiseAND(F.lit(1)) == 1).drop("cell", "marks")


def _met(left: DataFrame, right: DataFrame, near: Column) -> DataFrame:
    """``node, other``: pairs of a bucket that are near.  Merged, as the planner's estimate knows nothing of the many tables."""
    return left.join(right.hint("merge"), "key").where(near).select("node", "other").distinct()


def _verified(pairs: DataFrame, plain: DataFrame, labelled: DataFrame) -> DataFrame:
    """``node`` of the pairs whose words are similar; words are looked up for pairs, not carried through the tables."""
    worded = pairs.join(plain.select("node", "words"), "node").join(labelled.select(F.col("node").alias("other"), F.col("words").alias("other_words")), "other")
    return worded.where(_similarities(F.col("words"), F.col("other_words")) >= SIMILARITY).select("node").distinct()


def _filler_words(nodes: DataFrame, least_units: int = 3) -> DataFrame:
    """Words that trusted filler uses and other text hardly does: in at least ``least_units`` filler nodes, and in more of them than elsewhere."""
    words = nodes.select((F.coalesce("kind", F.lit("")) == FILLER).alias("filler"), F.explode(F.array_distinct(F.split("words", " "))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if("filler").alias("inside"), F.count_if(~F.col("filler")).alias("outside"))
    return counts.where((F.col("inside") >= least_units) & (F.col("inside") > F.col("outside"))).select("word")


def _vocabulary_filler(nodes: DataFrame, share: float = 0.9, least_words: int = 6) -> DataFrame:
    """``node, kind``: plain nodes nearly all of whose words are filler words.

    Left out is filler without a sign of under ``least_words`` words, and, as
    the words come from trusted filler of the same input, all such filler where
    fewer than three trusted filler nodes share its words: a small input may
    miss a document that a large one finds.
    """
    plain = nodes.where(F.col("kind").isNull()).withColumn("split", F.split("words", " ")).where(F.size("split") >= least_words)
    words = plain.select("node", F.size("split").alias("n"), F.explode("split").alias("word"))
    vocabulary = written(_filler_words(nodes), "vocabulary")  # its size is then known, and joined accordingly
    known = words.join(vocabulary, "word").groupBy("node", "n").agg(F.count(F.lit(1)).alias("known"))
    return known.where(F.col("known") >= share * F.col("n")).select("node", F.lit(FILLER).alias("kind"))


def _likely(nodes: DataFrame, sample: int) -> DataFrame:
    """``node, kind``: plain units in the place of a diff that speak like the signed error pages and script notices.

    A word model, fitted on at most ``sample`` signed and as many plain nodes,
    those with the least ids: the log odds of a word are those of meeting it in a
    signed node against a plain one, of a unit the sum over its words.  A word in
    fewer than LEAST_NODES of the sampled nodes of a side says nothing for it.
    """
    signed = nodes.where(F.col("kind").isin(ERROR, SCRIPT) & ~F.col("hunks")).orderBy("node").limit(sample)
    plain = nodes.where(F.col("kind").isNull()).orderBy("node").limit(sample)
    fitted = written(signed.select(F.lit(True).alias("signed"), "words").unionByName(plain.select(F.lit(False).alias("signed"), "words")), "sample")
    words = fitted.select("signed", F.explode(F.array_distinct(F.split("words", " "))).alias("word"))
    counts = words.groupBy("word").agg(F.count_if("signed").alias("inside"), F.count_if(~F.col("signed")).alias("outside"))
    inside, outside = fitted.agg(F.count_if("signed")).scalar(), fitted.agg(F.count_if(~F.col("signed"))).scalar()
    odds = F.log((F.col("inside") + 0.5) / (inside + 1)) - F.log((F.col("outside") + 0.5) / (outside + 1))
    speaks = F.when(odds > 0, F.col("inside") >= LEAST_NODES).otherwise(F.col("outside") >= LEAST_NODES)
    weights = written(counts.select("word", odds.alias("odds")).where(speaks), "odds")
    bare = nodes.where(F.col("kind").isNull() & ~F.col("hunks")).select("node", F.explode(F.array_distinct(F.split("words", " "))).alias("word"))
    return bare.join(weights, "word").groupBy("node").agg(F.sum("odds").alias("odds")).where(F.col("odds") > LEAST_ODDS).select("node", F.lit(WORDING).alias("kind"))


def _by_sentences(said: DataFrame, labelled: DataFrame) -> DataFrame:
    """``node``: units, SENTENCE_PART or more of whose words are in sentences of which SENTENCE_SHARE or more of the units are residue; labelled ones included.

    ``said`` is ``node, sentence, size, words``, a row per unit and sentence.
    """
    marked = said.join(labelled.select("node", F.lit(1).alias("known")), "node", "left")
    # counted by sentence with map-side combining and joined back, so that no task gathers the units of a stock sentence
    stock = marked.groupBy("sentence").agg(F.count("known").alias("known"), F.count(F.lit(1)).alias("n")).where(F.col("known") >= F.greatest(F.lit(1), SENTENCE_SHARE * F.col("n"))).select("sentence")
    held = said.join(stock, "sentence", "left_semi").groupBy("node", "words").agg(F.sum("size").alias("held"))
    return held.where(F.col("held") >= SENTENCE_PART * F.col("words")).select("node")


def residue(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, kind``: a row per document that is residue instead of a commit.

    ``documents`` has doc_id and text; other columns are not read.  Null and
    empty texts, terse or empty messages, merges and release notes are no
    residue, nor is text quoted in a sentence or carried in hunks, nor one line
    that reads like a commit's subject.  Rows of one doc_id count together.  The
    kind is the least of those its own signs tell; without a sign it is
    ``filler`` or ``wording`` where its words tell, ``linked`` where a label was
    passed on to it.  An empty table gives no rows.  The part below a merge
    subject may be residue, unless it lists what was merged or is one title
    without a full stop.  ``sample`` bounds the nodes that the word model is
    fitted on; all nodes are judged by it.
    """
    units = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_units, UNITS), "units")
    least = ("hunks", "words", "hash", "n_shingles", "prefix", "kind")
    nodes = written(units.groupBy("node").agg(*(F.min(c).alias(c) for c in least)), "nodes")
    said = written(units.where(F.size("sentences") > 0).select("node", F.size(F.split("words", " ")).alias("words"), F.inline("sentences")).distinct(), "said")
    worded = written(_vocabulary_filler(nodes).unionByName(_likely(nodes, sample)).groupBy("node").agg(F.min("kind").alias("kind")), "worded")
    frontier = written(nodes.where(F.col("kind").isNotNull()).unionByName(nodes.drop("kind").join(worded, "node").select(*nodes.columns)), "ring")
    labelled = frontier.select("node")
    plain = nodes.where(F.col("kind").isNull()).join(worded.select("node"), "node", "left_anti")
    linked = None
    while True:
        reached = near_labelled(plain, frontier).unionByName(similar_labelled(plain, frontier)).unionByName(_by_sentences(said, labelled)).distinct()
        frontier = written(plain.join(reached, "node"), "ring")
        if frontier.isEmpty():
            break
        linked = frontier.select("node") if linked is None else linked.unionByName(frontier.select("node"))
        labelled = labelled.unionByName(frontier.select("node"))
        plain = plain.join(frontier.select("node"), "node", "left_anti")
    passed = worded if linked is None else worded.unionByName(linked.withColumn("kind", F.lit(LINKED)))
    # a node with a sign in one place may lack it in another, as equal words may be judged apart by their marks;
    # errors and notices are told by words, so all documents of the node have them
    same = units.where(F.col("kind").isin(ERROR, SCRIPT)).select("node", "kind").distinct()
    own = units.where(F.col("kind").isNotNull()).select("doc_id", "kind").unionByName(units.select("doc_id", "node").join(same, "node").select("doc_id", "kind"))
    told = own.withColumn("linked", F.lit(None).cast("string")).unionByName(units.select("doc_id", "node").join(passed, "node").select("doc_id", F.lit(None).cast("string").alias("kind"), F.col("kind").alias("linked")))
    return told.groupBy("doc_id").agg(F.coalesce(F.min("kind"), F.min("linked")).alias("kind"))


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that are not residue, all their columns and rows kept; a null doc_id is kept."""
    found = residue(documents).select(F.col("doc_id").alias("residue_doc_id"))
    return documents.join(found, F.col("doc_id").cast("long") == F.col("residue_doc_id"), "left_anti")
