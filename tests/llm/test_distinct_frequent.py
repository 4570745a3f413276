import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import distinct, frequent

SCHEMA = "uid string, day string, country string, key string, cells string, n long, level int"
GROUPS = ("day", "country", "key")


def columns():
    return {g: F.col(g) for g in GROUPS}



def rows_of(seed=1, n=500):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = [(pick("hot", *map(str, range(20)), None) if rng.random() > 0.33 else "hot", pick("d1", "d2", "d3", None), pick("GB", "DE", None), pick("k1", "k2", None), "x", 1, 2) for _ in range(n)]
    return rows + rows[:50]


@pytest.mark.parametrize("at_once", [500_000, 3])
def test_cube_is_exact(spark, at_once, monkeypatch):
    monkeypatch.setattr(distinct, "CELLS_AT_ONCE", at_once)
    rows = rows_of()
    members = distinct.membership(spark.createDataFrame(rows, SCHEMA), F.col("uid"), columns())
    found = {tuple(r)[:4]: (r["n_distinct"], r["error_bound"]) for r in distinct.distinct_cube(distinct.pattern_totals(members), list(GROUPS)).collect()}
    expected = {}
    for level, used in enumerate(product((False, True), repeat=3)):
        for row in rows:
            values = row[1:4]
            if row[0] is None or any(u and v is None for u, v in zip(used, values)):
                continue
            expected.setdefault((level, *(v if u else None for u, v in zip(used, values))), set()).add(row[0])
    assert found == {k: (len(v), 0) for k, v in expected.items()}


def test_partial_results_merge(spark):
    rows = rows_of(2)
    part = lambda some: distinct.membership(spark.createDataFrame(some, SCHEMA), F.col("uid"), columns())
    merged = distinct.merge_memberships(part(rows[:100]), part(rows[100:300]), part(rows[300:]))
    key = lambda frame: {r["identifier"]: [tuple(c) for c in r["cells"]] for r in frame.collect()}
    assert key(merged) == key(part(rows))
    low, high = (distinct.pattern_totals(merged.where(c)) for c in (F.col("identifier") < "2", F.col("identifier") >= "2"))
    both = {str(r["cells"]): r["n"] for r in distinct.merge_patterns(low, high).collect()}
    assert both == {str(r["cells"]): r["n"] for r in distinct.pattern_totals(merged).collect()}


def test_sketches_of_cells_merge_and_bound_the_error(spark):
    """Small cells are exact; large ones lie within the bound; merging parts gives what the whole gives."""
    rows = rows_of(6, 800) + [(f"u{i % 30_000}", "d1" if i % 3 else "d2", "FR", None, "x", 1, 2) for i in range(40_000)]
    data = spark.createDataFrame(rows, SCHEMA).repartition(4, F.rand(3))
    whole = distinct.cell_sketches(data, F.col("uid"), columns())
    parts = distinct.merge_cell_sketches(*(distinct.cell_sketches(data.where(c), F.col("uid"), columns()) for c in (F.col("uid") < "u2", F.col("uid") >= "u1", F.col("day").isNull())))
    exact = {tuple(r)[:4]: r["n_distinct"] for r in distinct.distinct_cube(distinct.pattern_totals(distinct.membership(data, F.col("uid"), columns())), list(GROUPS)).collect()}
    for cells in (whole, parts):
        found = {tuple(r)[:4]: r for r in distinct.estimated_cube(cells).collect()}
        assert set(found) == set(exact)
        assert all(abs(found[k]["n_distinct"] - n) <= found[k]["error_bound"] for k, n in exact.items()) and max(exact.values()) > 29_000
    assert distinct.estimated_cube(distinct.cell_sketches(data.limit(0), F.col("uid"), columns())).collect() == []


def test_any_combination(spark):
    rows = rows_of(3, 60)
    patterns = distinct.pattern_totals(distinct.membership(spark.createDataFrame(rows, SCHEMA), F.col("uid"), columns()))
    on = lambda d: lambda c: c["day"] == d
    found = distinct.count_matching(patterns, all_of=[on("d1")], any_of=[on("d2"), on("d3")], none_of=[lambda c: c["country"] == "GB"]).first()[0]
    of = {}
    for row in rows:
        if row[0]:
            of.setdefault(row[0], []).append(row)
    days = {u: {r[1] for r in rs} for u, rs in of.items()}
    assert found == sum("d1" in d and bool(d & {"d2", "d3"}) and all(r[2] != "GB" for r in of[u]) for u, d in days.items())
    assert distinct.count_matching(patterns.limit(0)).first()[0] == 0


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    patterns = distinct.pattern_totals(distinct.membership(empty, F.col("uid"), columns()))
    assert distinct.distinct_cube(patterns, list(GROUPS)).collect() == []
    assert frequent.frequent_values(empty, F.col("uid"), 0.1).collect() == []


@given(st.lists(st.lists(st.integers(0, 12), max_size=40), min_size=1, max_size=6), st.integers(1, 3))
def test_votes_bound_counts_in_any_order_of_merging(parts, bits):
    """The guarantees of the sketch, on values whose hashes are their own numbers."""
    width, state = 1 << bits, None
    true = Counter()
    for part in parts:
        true.update(part)
        if not part:
            continue
        values, votes = np.unique(np.array(part, np.int64), return_counts=True)
        made = frequent._vote(frequent._cells(values, 0, bits), values, votes.astype(np.int64), width)
        if state is None:
            state = [x.copy() for x in made]
            continue
        total, candidate, surplus = state
        same = candidate == made[1]
        wins = ~same & (made[2] > surplus)
        state = [total + made[0], np.where(wins, made[1], candidate), np.where(same, surplus + made[2], np.abs(surplus - made[2]))]
    if state is None:
        return
    total, candidate, surplus = state
    for value, count in true.items():
        cell = value & (width - 1)
        if candidate[cell] == value and total[cell]:
            assert surplus[cell] <= count <= (total[cell] + surplus[cell]) / 2
        else:
            assert count <= (total[cell] - surplus[cell]) / 2


@pytest.mark.parametrize("at_once", [200_000, 40])
def test_frequent_values(spark, at_once, monkeypatch):
    monkeypatch.setattr(frequent, "VOTES_AT_ONCE", at_once)
    rng = random.Random(4)
    values = ["big"] * 300 + [" big"] * 100 + ["mid"] * 60 + ["x" * 40_000] * 50 + [None, "", "  ", "\t\r\n"] * 30 + [f"rare{i}" for i in range(1500)] + ["tie1"] * 30 + ["tie2"] * 30
    rng.shuffle(values)
    data = spark.createDataFrame([(v, 1, "y") for v in values], "v string, h long, item string").repartition(5)
    counts = Counter(v for v in values if v and v.strip())
    for share in (0.2, 0.014, 30 / sum(counts.values())):
        found = frequent.frequent_values(data, F.col("v"), share).collect()
        least = share * sum(counts.values())
        assert {r["item"]: r["n_rows"] for r in found} == {v: n for v, n in counts.items() if n >= least}
        assert all(r["lower_bound"] <= r["n_rows"] <= r["upper_bound"] for r in found)
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            frequent.frequent_values(data, F.col("v"), bad)


@pytest.mark.parametrize("most_bits", [18, 4])
def test_many_frequent_values_end_in_two_reads(spark, most_bits, monkeypatch):
    """Hundreds of values of about the share, more than cells in one case; the bounds enclose the counts."""
    monkeypatch.setattr(frequent, "MOST_BITS", most_bits)
    counts = {f"v{i}": 20 + i % 3 for i in range(900)} | {f"rare{i}": 1 for i in range(2000)}
    data = spark.createDataFrame([(v,) for v, n in counts.items() for _ in range(n)], "v string").repartition(4, F.rand(1))
    share = 21 / sum(counts.values())
    found = frequent.frequent_values(data, F.col("v"), share).collect()
    assert {r["item"]: r["n_rows"] for r in found} == {v: n for v, n in counts.items() if n >= 21}
    assert all(r["lower_bound"] <= r["n_rows"] <= r["upper_bound"] for r in found)


def test_sketches_merge(spark):
    hashed = spark.range(3000).select(F.xxhash64(F.col("id") % 7).alias("h"))
    whole = frequent.sketch(hashed.coalesce(1), 4)
    parts = frequent.merge_sketches(frequent.sketch(hashed.where("h > 0"), 4).unionByName(frequent.sketch(hashed.where("h <= 0"), 4)))
    total = lambda f: {(r["row"], r["cell"]): r["total"] for r in f.collect()}
    assert total(whole) == total(parts) and whole.count() <= 4 * 16
