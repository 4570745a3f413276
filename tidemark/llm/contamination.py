"""Evaluation passages in a corpus, by greedy string tiling over Karp-Rabin seeds.

Texts are words: runs of a-z and 0-9 of the lower-cased text.  Every run of
``least`` words of the test items is a seed, hashed by Karp-Rabin over word
hashes.  Documents are hashed with the same rolling function, all bytes of a
batch at once; seeds they share with items are joined, and each document-item
pair with shared seeds is tiled: the longest match is marked, then the longest
among what is left, until nothing of ``least`` words remains.  Marked words
belong to one tile, so passages in another order add up to the coverage of the
item.  Tiles are compared word for word; a hash alone decides nothing.

Matches are chained from the positions of shared seeds where those are few.
Where words repeat, so that seeds meet at many more positions than there are words,
the longest match is found by hashing all unmarked runs of one length at a time,
its length by bisection: memory then grows with the words and not with their pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Test items travel to the executors in blocks of at most this many characters.
BLOCK_CHARS = 4_000_000
#: Bytes of text hashed at once.
CHUNK_BYTES = 1_000_000

#: Positions where seeds meet, for each word of both texts, up to which they are listed.
PAIRS_A_WORD = 4

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True

TILES = "doc_id long, item_id long, n_tiles int, longest int, matched_words int, item_words int"


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                known = getattr(self, name)
                while len(known) < size:
                    known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
                setattr(self, name, known)
        return self.up[:size], self.down[:size]


_POWERS = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, 64-bit hash and text number of every word of concatenated lower-case UTF-8 texts.

    Worked off in segments that end between words, so that a long text needs no
    more memory than its words.
    """
    parts, begin = [], 0
    while begin < len(data) or not parts:
        end = begin + CHUNK_BYTES
        while end < len(data) and _IS_WORD[data[end]]:
            end += 1
        inside = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end, side="right")] - begin
        first, last, hashed = _segment_words(data[begin:end], inside)
        parts.append((first + begin, last + begin, hashed))
        begin = end
    first, last, hashed = (np.concatenate(p) for p in zip(*parts))
    return first, last, hashed, np.searchsorted(offsets, first, side="right") - 1


def _segment_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = len(data)
    word = _IS_WORD[data]
    edge = np.zeros(size + 1, bool)
    edge[edges[edges <= size]] = True
    before = np.concatenate([[False], word])
    after = np.concatenate([word, [False]])
    begin = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    up, down = _POWERS.upto(size + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:size], dtype=np.uint64)])
    hashed = _mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return begin, end, hashed


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``length`` hashes, by doubling the run."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    blocks, size, bit = None, 0, 1
    power = hashes
    while True:
        if length & bit:
            if blocks is None:
                blocks, size = power, bit
            else:
                n = len(power) - size
                blocks = blocks[:n] * np.uint64(pow(int(_WORD_BASE), bit, 1 << 64)) + power[size : size + n]
                size += bit
        bit *= 2
        if bit > length:
            return _mix(blocks[: len(hashes) - length + 1])
        half = bit // 2
        power = power[:-half] * np.uint64(pow(int(_WORD_BASE), half, 1 << 64)) + power[half:]


def greedy_tiles(seeds: np.ndarray, least: int, doc_words: int, item_words: int) -> list[tuple[int, int, int]]:
    """Longest non-overlapping matches, longest first, from (document, item) positions of shared seeds."""
    diagonal = seeds[:, 0] - seeds[:, 1]
    order = np.lexsort((seeds[:, 0], diagonal))
    at, line = seeds[order], diagonal[order]
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(at[:, 0]) != 1)]))
    lengths = np.diff(np.append(fresh, len(at))) + least - 1
    heap = [(-int(n), int(at[i, 0]), int(at[i, 1])) for n, i in zip(lengths, fresh)]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(doc_words, bool), np.zeros(item_words, bool)
    tiles = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        free = ~(in_doc[p : p + n] | in_item[q : q + n])
        if free.all():
            in_doc[p : p + n] = in_item[q : q + n] = True
            tiles.append((p, q, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= least:
                heapq.heappush(heap, (-int(b - a), p + int(a), q + int(a)))
    return tiles


def _free_runs(marked: np.ndarray, length: int) -> np.ndarray:
    """Where runs of ``length`` unmarked words begin."""
    before = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(before[length:] == before[:-length])


def greedy_tiles_by_length(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles of ``greedy_tiles`` from the word hashes of both sides, without listing the positions where seeds meet."""
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []

    def shared(length: int) -> tuple[int, int] | None:
        """The first place in the document, and then in the item, of an unmarked run that both have."""
        one, two = _free_runs(in_doc, length), _free_runs(in_item, length)
        if not len(one) or not len(two):
            return None
        left, right = rolling(doc, length)[one], rolling(item, length)[two]
        hit = np.flatnonzero(np.isin(left, right))
        return (int(one[hit[0]]), int(two[np.flatnonzero(right == left[hit[0]])[0]])) if len(hit) else None

    most = min(len(doc), len(item))
    while most >= least:
        low, high, found = least, most, None
        while low <= high:  # a shared run has shared runs of every shorter length
            middle = least if found is None and low == least else (low + high + 1) // 2
            at = shared(middle)
            if at is None:
                high = middle - 1
            else:
                low, found = middle + 1, (*at, middle)
        if found is None:
            break
        p, q, most = found
        in_doc[p : p + most] = in_item[q : q + most] = True
        tiles.append(found)
    return tiles


def _crossed(a_begin: np.ndarray, a_count: np.ndarray, b_begin: np.ndarray, b_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all pairs of a member of its range of a and one of its range of b."""
    size = a_count * b_count
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(b_count, size)
    return np.repeat(a_begin, size) + within // wide, np.repeat(b_begin, size) + within % wide


class ItemIndex:
    """Seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.least = least
        self.ids = [i for i, _ in items]
        raw = [t.encode() for _, t in items]
        offsets = np.cumsum([0, *map(len, raw)])[:-1]
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        begin, end, hashed, owner = words_of(data, offsets)
        self.hashed = hashed
        self.words = [joined[a:b] for a, b in zip(begin, end)]
        self.first = np.searchsorted(owner, np.arange(len(items) + 1))
        seeds = rolling(hashed, least)
        place = np.flatnonzero(owner[: len(seeds)] == owner[least - 1 : least - 1 + len(seeds)])
        order = place[np.argsort(seeds[place], kind="stable")]
        self.place = order
        fresh = np.ones(len(order), bool)  # an entry per seed and item: where its places begin, and how many they are
        fresh[1:] = (seeds[order][1:] != seeds[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        self.begin = np.flatnonzero(fresh)
        self.count = np.diff(np.append(self.begin, len(order)))
        self.seed, self.item = seeds[order][fresh], owner[order][fresh]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.seed & np.uint64((1 << 20) - 1)] = True

    def tile(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text number, item, tiles, longest, words matched, words of the item) of texts that share a tile with an item."""
        begin, end, hashed, owner = words_of(data, offsets)
        seeds = rolling(hashed, self.least)
        hit = np.flatnonzero(self.filter[seeds & np.uint64((1 << 20) - 1)])
        hit = hit[owner[hit] == owner[hit + self.least - 1]]
        if len(self.seed):  # the filter lets some through that are no seeds
            hit = hit[self.seed[np.minimum(np.searchsorted(self.seed, seeds[hit]), len(self.seed) - 1)] == seeds[hit]]
        first_word = np.searchsorted(owner, np.arange(len(offsets) + 1))
        raw = data.tobytes()
        for t in np.unique(owner[hit]):
            at = hit[np.searchsorted(owner[hit], t) : np.searchsorted(owner[hit], t, side="right")]
            d0, n_doc = int(first_word[t]), int(first_word[t + 1] - first_word[t])
            at = at[np.argsort(seeds[at], kind="stable")]
            seed, begin_at, count = np.unique(seeds[at], return_index=True, return_counts=True)
            low = np.searchsorted(self.seed, seed, side="left")
            which, entry = _crossed(np.arange(len(seed)), np.ones(len(seed), np.int64), low, np.searchsorted(self.seed, seed, side="right") - low)
            order = np.argsort(self.item[entry], kind="stable")
            which, entry = which[order], entry[order]
            edges = np.flatnonzero(np.concatenate([[True], np.diff(self.item[entry]) != 0, [True]])) if len(entry) else []
            for a, b in zip(edges[:-1], edges[1:]):
                mine, seeds_of = entry[a:b], which[a:b]
                i = int(self.item[mine[0]])
                i0, n_item = int(self.first[i]), int(self.first[i + 1] - self.first[i])
                if (count[seeds_of] * self.count[mine]).sum() <= PAIRS_A_WORD * (n_doc + n_item):
                    here, there = _crossed(begin_at[seeds_of], count[seeds_of], self.begin[mine], self.count[mine])
                    tiles = greedy_tiles(np.stack([at[here] - d0, self.place[there] - i0], axis=1), self.least, n_doc, n_item)
                else:
                    tiles = greedy_tiles_by_length(hashed[d0 : d0 + n_doc], self.hashed[i0 : i0 + n_item], self.least)
                same = [n for p, q, n in tiles if [raw[begin[k] : end[k]] for k in range(d0 + p, d0 + p + n)] == self.words[i0 + q : i0 + q + n]]
                if same:
                    yield int(t), i, len(same), max(same), sum(same), n_item


def _kernel(index):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in batches:
            rows = []
            ids = batch.column(0)
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            begin = 0
            while begin < len(texts):
                stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK_BYTES, side="right")) - 1)
                part = data[offsets[begin] : offsets[stop]]
                for t, i, *found in items.tile(part, offsets[begin:stop] - offsets[begin]):
                    rows.append((ids[begin + t].as_py(), items.ids[i], *found))
                begin = stop
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                names = ("doc_id", "item_id", "n_tiles", "longest", "matched_words", "item_words")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))

    return find


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Distinct items in blocks of bounded size; the whole list is never held."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row["text"]) > limit:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def contaminated(documents: DataFrame, items: DataFrame, least: int = 13, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, n_tiles, longest, matched_words, item_words, coverage``: a row per document and item sharing a tile.

    ``documents`` has doc_id and text, ``items`` has item_id and text; other
    columns are not read.  A tile is at least ``least`` words in the same order
    on both sides.  ``coverage`` is the part of the item's words inside tiles.
    Null texts have no words; items without id or text, and those shorter than
    ``least`` words, match nothing.  Repeated rows of an item are one item.  The
    items are the stated query set: they are broadcast in blocks of at most
    ``block_chars`` characters, each of which reads all documents once.
    """
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    spark = documents.sparkSession
    found = None
    for block in _blocks(wanted, block_chars):
        index = spark.sparkContext.broadcast(ItemIndex(block, least))
        part = texts.mapInArrow(_kernel(index), TILES)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], TILES)
    return found.withColumn("coverage", F.col("matched_words") / F.col("item_words"))


def leaked_items(items: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``item_id, n_documents, best_coverage, leaked``: every item, with how far it leaked.

    ``leaked`` holds where one document covers at least ``threshold`` of the
    item's words, in whatever order.  Items nobody holds have 0 documents.
    """
    worst = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"), F.max("coverage").alias("best"))
    ids = items.select(F.col("item_id").cast("long").alias("item_id")).where(F.col("item_id").isNotNull()).distinct()
    joined = ids.join(worst, "item_id", "left")
    best = F.coalesce("best", F.lit(0.0))
    return joined.select("item_id", F.coalesce("n", F.lit(0)).alias("n_documents"), best.alias("best_coverage"), (best >= threshold).alias("leaked"))
