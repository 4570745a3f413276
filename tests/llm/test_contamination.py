import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import contamination as c

WORD = re.compile("[a-z0-9]+")


def buffer_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])[:-1]


@settings(max_examples=80)
@given(st.lists(st.text("ab1 -\n+éß", max_size=30), min_size=1, max_size=5))
def test_words(texts):
    data, offsets = buffer_of(texts)
    begin, end, hashed, owner = c.words_of(data, offsets)
    raw = data.tobytes()
    found = [(int(o), raw[a:b].decode()) for o, a, b in zip(owner, begin, end)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]
    same = {}
    for (_, word), h in zip(found, hashed):
        assert same.setdefault(word, h) == h
    assert len(set(same.values())) == len(same)


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 17))
def test_rolling_hash(values, length):
    hashes = np.array(values, np.uint64) * np.uint64(0x12345678DEADBEEF)
    found = c.rolling(hashes, length)
    runs = [tuple(values[i : i + length]) for i in range(len(values) - length + 1)]
    assert len(found) == len(runs)
    seen = {}
    for run, h in zip(runs, found):
        assert seen.setdefault(run, h) == h
    assert len(set(seen.values())) == len(seen)


def tiles_by_force(doc, item, least):
    """Greedy string tiling by looking at everything each time."""
    in_doc, in_item, tiles = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and not in_doc[p + n] and not in_item[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return tiles
        in_doc[p : p + n] = in_item[q : q + n] = [True] * n
        tiles += n


@settings(max_examples=80)
@given(st.lists(st.integers(0, 2), max_size=16), st.lists(st.integers(0, 2), max_size=16), st.integers(2, 4))
def test_tiles(doc, item, least):
    seeds = [(p, q) for p in range(len(doc) - least + 1) for q in range(len(item) - least + 1) if doc[p : p + least] == item[q : q + least]]
    if not seeds:
        return
    tiles = c.greedy_tiles(np.array(seeds), least, len(doc), len(item))
    for k, (p, q, n) in enumerate(tiles):
        assert n >= least and doc[p : p + n] == item[q : q + n]
        for p2, q2, n2 in tiles[:k]:
            assert (p + n <= p2 or p2 + n2 <= p) and (q + n <= q2 or q2 + n2 <= q)
    longest = max(n for _, _, n in tiles)
    assert longest == max(next(k for k in range(17) if p + k >= len(doc) or q + k >= len(item) or doc[p + k] != item[q + k]) for p, q in seeds)
    if len(seeds) == 1:
        assert sum(n for *_, n in tiles) == tiles_by_force(doc, item, least)


@settings(max_examples=150)
@given(st.lists(st.integers(0, 2), max_size=24), st.lists(st.integers(0, 2), max_size=24), st.integers(1, 4))
def test_tiles_by_length_are_the_same(doc, item, least):
    seeds = [(p, q) for p in range(len(doc) - least + 1) for q in range(len(item) - least + 1) if doc[p : p + least] == item[q : q + least]]
    hashed = [np.array(x, np.uint64) * np.uint64(0x12345678DEADBEEF) for x in (doc, item)]
    expected = c.greedy_tiles(np.array(seeds), least, len(doc), len(item)) if seeds else []
    assert c.greedy_tiles_by_length(*hashed, least) == expected


@pytest.mark.parametrize("phrase", [["same"], ["over", "and", "out"]])
def test_repeated_words_take_memory_by_words(phrase):
    """A repeated word or phrase: positions where seeds meet are the product of both lengths, and are not listed."""
    import tracemalloc

    item, doc = (phrase * n for n in (3_000 // len(phrase), 60_000 // len(phrase)))
    index = c.ItemIndex([(1, " ".join(item)), (2, " ".join(item[:40]))], 13)
    data, offsets = buffer_of([" ".join(doc), "nothing here"])
    tracemalloc.start()
    found = list(index.tile(data, offsets))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 1, len(item), len(item), len(item)), (0, 1, 1, 40, 40, 40)] and peak < 60_000_000


def words(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "delta", "x1", "y2"]) + str(rng.randrange(40)) for _ in range(n)]


@pytest.mark.parametrize("block_chars", [10**6, 200])
@pytest.mark.parametrize("chunk", [10**6, 64])
def test_contaminated(spark, block_chars, chunk, monkeypatch):
    monkeypatch.setattr(c, "CHUNK_BYTES", chunk)
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, 30))) for i in range(6)]
    items += [(6, items[0][1].upper()), (7, "too short"), (8, None), (None, items[1][1]), (9, ""), items[2]]
    docs = []
    for i in range(40):
        noise, passage = words(rng, 40), items[i % 6][1].split()
        kind = i % 5
        if kind == 0:  # a passage, in capitals, over line marks
            noise[20:20] = "\n+ ".join(passage[3:16]).upper().split(" ")
        elif kind == 1:  # one word short
            noise[20:20] = passage[3:15]
        elif kind == 2:  # both halves in the other order
            noise[10:10], noise[40:40] = passage[15:], passage[:15]
        docs.append((i, " ".join(noise)))
    docs += [(100, None), (101, ""), (102, "é" * 50), (103, (" ".join(words(rng, 30_000)) + " " + items[3][1])), docs[0]]
    extra = spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id long, text string, item_id string, n_tiles int").repartition(3)
    table = spark.createDataFrame([(*i, "s") for i in items], "item_id long, text string, doc_id string")
    found = {(r["doc_id"], r["item_id"]): r for r in c.contaminated(extra, table, 13, block_chars).collect()}

    def runs(text):
        w = WORD.findall((text or "").lower())
        return {tuple(w[k : k + 13]) for k in range(len(w) - 12)}

    held = {i: runs(t) for i, t in items if i is not None}
    assert set(found) == {(d, i) for d, t in docs for i in held if runs(t) & held[i]}
    assert found[103, 3]["coverage"] == 1.0
    turned = found[2, 2]
    assert turned["n_tiles"] == 2 and turned["coverage"] == 1.0 and turned["longest"] == 15
    report = {r["item_id"]: r for r in c.leaked_items(table, c.contaminated(extra, table), 0.5).collect()}
    assert set(report) == set(range(10)) and report[2]["leaked"] and not report[7]["leaked"] and report[9]["n_documents"] == 0
    assert report[0]["n_documents"] == len({d for d, i in found if i == 0})


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert c.contaminated(some, items).collect() == [] and c.contaminated(none, some.select(F.col("doc_id").alias("item_id"), "text")).collect() == []
