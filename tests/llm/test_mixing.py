import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, tokens
from tidemark.llm.tokens import _count, _encoding, token_count, VOCABULARY

DOCS = "doc_id long, text string, source string, n_tokens string, place string, slice string"
TARGETS = "source string, target_share double, max_repeats int, whole long"


def sized(spark, rows):
    """Sizes as given instead of counted."""
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 1))


def queues_by_force(sizes, targets, budget):
    uses = []
    for source, share, repeats in targets:
        total = 0
        mine = sorted((r for r in sizes if r["source"] == source), key=lambda r: (r["place"], r["doc_id"], r["n_tokens"]))
        for repeat in range(1, repeats + 1):
            for r in mine:
                total += r["n_tokens"]
                uses.append((total / share, source, r["doc_id"], repeat, r["n_tokens"]))
    chosen, left = [], budget
    for use in sorted(uses):
        if use[-1] > left:
            break
        left -= use[-1]
        chosen.append(use)
    return chosen


@pytest.mark.parametrize("seed, bits", [(1, 12), (2, 1), (3, 3)])
def test_mixture_is_the_queues_order(spark, seed, bits, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_BITS", bits)
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "other"]), rng.choice([0, 1, 5, 50, 400])) for i in range(300)]
    targets = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)]
    data = sized(spark, rows)
    table = spark.createDataFrame([(*t, 1) for t in targets], TARGETS)
    whole = sum(r[2] for r in rows)
    for budget in (None, whole // 3, 0, 10 * whole):
        found = [(r["virtual_finish"], r["source"], r["doc_id"], r["repeat"], r["n_tokens"]) for r in mixing.mixture(data, table, budget).collect()]
        assert found == queues_by_force(data.collect(), targets, whole if budget is None else budget)


def test_report(spark):
    rows = [(i, "big", 10) for i in range(80)] + [(100 + i, "small", 10) for i in range(10)] + [(200 + i, "rest", 10) for i in range(10)]
    targets = [("BIG ", 0.5, 1, 1), ("small", 0.35, 2, 1), ("small", 0.05, 3, 1), ("gone", 0.1, 4, 1), ("zero", 0.0, 1, 1), (None, 0.1, 1, 1), ("never", 0.1, 0, 1)]
    report = {r["source"]: r for r in mixing.mixture_report(sized(spark, rows), spark.createDataFrame(targets, TARGETS)).collect()}
    assert {s for s, r in report.items() if r["runs_dry"]} == {"small", "gone", "never"}
    assert report["small"]["available"] == 300 and report["small"]["actual_tokens"] == 300 and report["small"]["max_repeats"] == 3
    assert report["big"]["actual_tokens"] == 700 and report["big"]["actual_share"] == 0.7 and report["gone"]["actual_share"] == 0.0


def test_only_what_can_be_served_is_scheduled(spark):
    data = sized(spark, [(i, "a", 10) for i in range(50)] + [(100, "b", 0), (101, "c", 5)])
    table = spark.createDataFrame([("a", 0.5, 1000, 1), ("b", 0.3, 3, 1), ("c", 0.2, 2, 1)], TARGETS)
    assert mixing.schedule(data, table).count() == 50_000 + 3 + 2
    assert mixing.schedule(data, table, 1500.0).count() == 75 + 3 + 2
    plan = mixing.schedule(data, table, 1500.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(1, max_repeats" not in plan and "least(" in plan


def test_shares_hold_where_nothing_runs_dry(spark):
    rows = [(i, s, 1 + i % 7) for i, s in enumerate(["a"] * 3000 + ["b"] * 900)]
    targets = spark.createDataFrame([("a", 0.75, 2, 1), ("b", 0.25, 2, 1)], TARGETS)
    for r in mixing.mixture_report(sized(spark, rows), targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.002


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1, 1)], TARGETS)
    report = mixing.mixture_report(mixing.sized_documents(docs), targets).collect()
    assert [(r["source"], r["runs_dry"], r["size"]) for r in report] == [("a", False, 0)]
    some = mixing.sized_documents(spark.createDataFrame([(1, "x y", "a", "", "", "")], DOCS))
    assert mixing.mixture(some, targets.limit(0)).collect() == [] and mixing.mixture_report(some, targets.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_long_texts_have_the_tokens_of_the_plain_encoder(seed, monkeypatch):
    """At every length, with runs of blanks of all kinds, cut into pieces and not."""
    rng = random.Random(seed)
    parts = ["word", "don't", "l'été", "42", "...", "漢字", "x" * 400, "'s", "_", " ", "\n", "\r\n", "\t", "\u00a0", " " * 6000, "\n" * 7000, " \n" * 4000, "\u3000" * 6000, "\x1c"]
    encoding = _encoding(VOCABULARY)
    for limit in (500_000, 7000):
        monkeypatch.setattr(tokens, "LONG_TEXT", limit)
        for n in (3, 40, 900):
            text = "".join(rng.choice(parts[:-7] if rng.random() < 0.97 else parts) + rng.choice(["", " "]) for _ in range(n)) + rng.choice(["", " " * 5500, "\n" * 5000, "end"])
            assert _count(encoding, text) == len(encoding.encode_ordinary(text))


def test_tokens(spark):
    texts = ["", None, "Hello world", "é" * 100, "a b\n" * 200_000, "x" + " " * 1_000_000 + "y", "\n" * 600_000, "a" * 600_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r[0]: r[1] for r in rows.select("i", token_count(F.col("t"))).collect()}
    encoding = _encoding(VOCABULARY)
    encode = encoding.encode_ordinary
    assert found == {i: _count(encoding, t) for i, t in enumerate(texts)} and found[2] == 2 and found[0] == found[1] == 0
    assert [found[i] for i in (3, 4, 7)] == [len(encode(texts[i])) for i in (3, 4, 7)]
    assert found[5] == 1 + len(encoding._encode_single_piece(" " * 999_999)) + len(encode(" y"))
    assert _encoding(VOCABULARY).decode(encode("round trip, ünïcode")) == "round trip, ünïcode"
    docs = spark.createDataFrame([(1, "Hello world", " A ", "9", "9", "9"), (2, None, None, "9", "9", "9"), (2, "x", "", "9", "9", "9")], DOCS)
    assert sorted(((r["source"], r["n_tokens"]) for r in mixing.sized_documents(docs).collect()), key=str) == [("a", 2), (None, 0), (None, 1)]
