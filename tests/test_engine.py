import pytest
from pyspark.sql import functions as F

from tests.library import SCHEMAS, TABLES, expected, lines, reader
from tidemark.errors import QueryError
from tidemark.functions.codecs import parse_schema
from tidemark.operators import spread
from tidemark.operators.frame import KeyedFrame
from tidemark.plans.ast import Condition, Logic, TableRef
from tidemark.plans.filters import FilterBuilder, predicate_column, where
from tidemark.plans.lower import Options
from tidemark.session import Engine
from tidemark.sources.ingest import line_records, typed

JOINED = "select reader from v.cards join select branch,at from v.visits"
TRAINING = (
    "select reader from v.notices where wanted='true' and topic='overdue' or topic='talks' join (select reader,title,due from v.loans where title contains 'b' "
    "union select reader,title,due,shelf from v.returns)"
)
BOTH = "select reader,title,due from v.loans where reader not = '" + reader(2) + "' {} select reader,title,due,shelf from v.returns"
STATEMENTS = [
    JOINED,
    JOINED + " where at > '2016-02-10 00:00:00'",
    "select topic,reader from v.notices join select title from v.loans",
    "select reader,topic from v.notices",
    "select reader,wanted from v.notices where topic='talks'",
    "select * from v.stock where title contains 'a'",
    "select * from v.stock where title contains ''",
    "select copies,*,copies from v.stock",
    "select * from v.bare",
    "select copies from (select * from v.stock where copies > 5) where title='bread'",
    "select title from v.bare join select * from v.stock",
    BOTH.format("union"),
    BOTH.format("intersection"),
    TRAINING,
]


@pytest.fixture(scope="module")
def engine(spark):
    made = Engine(spark, buckets=3)
    for name, schema in SCHEMAS.items():
        fields = parse_schema(schema)
        text = spark.createDataFrame([(line,) for line in lines(name)], "value string")
        made.register(f"v.{name}", typed(line_records(text, "|"), fields).rows, fields)
    return made


def run(engine, statement, ordered=True):
    found = list(engine.sql(statement).lines("|", ordered))
    return found if ordered else sorted(found)


@pytest.mark.parametrize("statement", STATEMENTS)
def test_statements_give_what_the_model_gives_in_order(engine, statement):
    rows = expected(statement)
    assert run(engine, statement) == rows
    assert engine.sql(f"count ({statement})").count == len(rows)


def test_the_cases_are_not_hollow():
    sizes = {s: len(expected(s)) for s in STATEMENTS}
    assert all((n > 1) is not ("bare" in s or "contains ''" in s or "title='bread'" in s) for s, n in sizes.items())
    assert len(expected(BOTH.format("union"))) > len(expected(BOTH.format("intersection")))


@pytest.mark.parametrize("threshold", ["10m", "-1"])  # beyond the threshold hot keys are salted
def test_training_set_by_broadcast_and_by_salts(spark, engine, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for statement in (TRAINING, "select topic,reader from v.notices join select title from v.loans"):
            assert run(engine, statement, False) == sorted(expected(statement))
            assert engine.sql(f"count ({statement})").count == len(expected(statement))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_counts_of_every_frame(engine):
    assert engine.sql("count (select title from v.stock) where title='knots'").count == 1
    assert engine.sql("count v.stock where copies < 10").count == 3
    assert engine.sql("count v.stock").count == 7


def test_errors(engine):
    for bad in ("select z from v.stock", "select title from v.stock where z=1", "select title from v.nowhere", "select title from v.stock join select reader from v.notices join select copies from v.bare where copies contains", "count v.nowhere",
                "select title,copies from v.stock union select reader from v.notices union select copies from v.zzz", "describe v.nowhere", "drop v.nowhere"):
        with pytest.raises(QueryError):
            engine.sql(bad)
    with pytest.raises(QueryError):  # the types of a shared column differ
        engine.frame("select title,copies from v.stock").union(KeyedFrame.table(engine.spark.createDataFrame([("x", "y")], "title string, copies string")))
    with pytest.raises(QueryError):  # the keys' types differ
        engine.frame("select title from v.stock").join(KeyedFrame.table(engine.spark.createDataFrame([(1,)], "k long")))


def test_literals_are_values_of_their_column(spark):
    made = Engine(spark)
    made.register("n.t", spark.createDataFrame([(-3, -0.5), (5, 2.25)], "v long, x double"))
    made.register("n.u", spark.createDataFrame([(1,)], "u int").selectExpr("'00000000-0000-0000-0000-000000000000' u", "1L ip", "timestamp_seconds(1) t", "1 i"), parse_schema("u(UUID),ip(IPV4),t(TIME),i(INT)"))
    assert made.sql("count n.t where v > -5").count == 2 and made.sql("count n.t where v < -2").count == 1 and made.sql("count n.t where x > '-0.75'").count == 2
    assert made.sql("count n.t where v in (-3, 4)").count == 1 and made.sql("count n.t where v contains '-'").count == 1
    for bad in ("v > 'abc'", "v not = 'abc'", "v in (1, 'x')", "v = 9223372036854775808", "x < 'low'"):
        with pytest.raises(QueryError):
            made.df(f"count n.t where {bad}")
    for bad in ("u = 'nobody'", "ip = '1.2.3'", "ip = '1.2.3.256'", "t > '2014-13-01 00:00:00'", "t > 'soon'", "i = 2147483648", "i = '1.5'"):
        with pytest.raises(QueryError):
            made.df(f"count n.u where {bad}")
    assert made.sql("count n.u where t > 0 and i > -1").count == 1


def test_null_keys_repeats_and_clashing_names(spark):
    made = Engine(spark)
    made.register("n.l", spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), (None, 2, "y"), ("b", None, None)], "key string, salt int, hot string"))
    made.register("n.r", spark.createDataFrame([("a", 5, "p"), ("a", 5, "p"), (None, 6, "q"), ("b", 7, None), ("c", 8, "s")], "key string, n int, hot string"))
    assert sorted(map(tuple, made.df("select * from n.l join select key,n from n.r").collect()), key=str) == [("a", 1, "x", 5), ("a", 1, "x", 5), ("b", None, None, 7)]
    assert made.sql("count (select * from n.l union select * from n.r)").count == 9
    assert made.sql("count (select * from n.l intersection select * from n.r)").count == 6
    assert made.df("select * from n.l where hot not = 'x'").count() == 1  # null is neither


ROWS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


@pytest.mark.parametrize("ops", [("AND", "AND"), ("AND", "OR"), ("OR", "AND"), ("OR", "OR")])
def test_predicates_nest_to_the_right(spark, ops):
    frame = spark.createDataFrame(ROWS, "a int, b int, c int")
    fields = parse_schema("a(INT),b(INT),c(INT)")
    one = {n: Condition(n, "=", ("1",)) for n in "abc"}
    tree = Logic(ops[0], one["a"], Logic(ops[1], one["b"], one["c"]))
    python = {"AND": lambda x, y: x and y, "OR": lambda x, y: x or y}
    right = {r for r in ROWS if python[ops[0]](r[0], python[ops[1]](r[1], r[2]))}
    assert {tuple(r) for r in frame.where(predicate_column(tree, fields)).collect()} == right
    sql = {r for r in ROWS if eval(f"{r[0]} {ops[0].lower()} {r[1]} {ops[1].lower()} {r[2]}")}
    assert {tuple(r) for r in frame.where(predicate_column(tree, fields, "sql")).collect()} == sql


def test_builder(spark):
    built = where("a").greater_than(1).and_("s").not_().contains("x").or_("b").in_(1, 2)
    assert str(built) == "a > '1' AND s NOT CONTAINS 'x' OR b IN ('1', '2')" and built.fields == ["a", "s", "b"]
    assert str(FilterBuilder.from_text(str(built))) == str(built) and str(FilterBuilder.from_text("*")) == "*"
    for bad in (lambda: where("a").predicate, lambda: where("a").and_("b"), lambda: FilterBuilder().equals(1)):
        with pytest.raises(QueryError):
            bad()


def test_string_order(spark):
    frame = spark.createDataFrame([("b",), ("aa",), ("é",), ("abc",), ("",)], "s string")
    fields = parse_schema("s(STRING)")
    above = lambda **o: {r[0] for r in frame.where(predicate_column(Condition("s", ">", ("b",)), fields, **o)).collect()}
    assert above() == {"aa", "é", "abc"} and above(string_order="lexical") == {"é"}
    assert Engine(spark, options=Options(string_order="lexical")).register("o.s", frame).df("select s from o.s where s < 'b'").count() == 3


def test_spread_keeps_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "HOT_PARTS", 4)
    rows = spark.createDataFrame([("hot", i) for i in range(60)] + [(f"k{i}", i) for i in range(20)] + [(None, 1)], "k string, v int")
    unique = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "k string, w int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [r["k"] for r in spread.hot_keys(rows, "k").collect()] == ["hot"]
        joined = spread.match_unique(rows, unique, "k")
        assert joined.groupBy("k").count().collect().__len__() == 2 and joined.count() == 61 and joined.columns == ["k", "v", "w"]
        assert spread.match_unique(rows, unique.select("k"), "k", "left_semi").count() == 61
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_grouped_and_text(engine):
    grouped = {r["key"]: (r["n"], r["branch"]) for r in engine.frame("select branch from v.visits").grouped(F.max("branch").alias("branch")).collect()}
    of = {}
    for card, branch, _ in TABLES["visits"]:
        of.setdefault(card, []).append(branch)
    assert grouped == {card: (len(branches), max(branches)) for card, branches in of.items()}
    by_length = sorted((title for title, _ in TABLES["stock"]), key=lambda t: (len(t), t))
    assert [r[0] for r in engine.sql("select title,copies from v.stock").records()] == by_length
    assert [r["title"] for r in engine.frame("select title from v.stock").output(descending=True).collect()] == by_length[::-1]
    assert [f.type.escape("x") for f in parse_schema("a,b(INT),c(UUID)")] == ["'x'", "x", "'x'"]
    assert engine.frame("select copies from v.stock").counted().columns == ["count"]


def test_columns_behind_the_last_one_selected_are_not_read(spark, tmp_path):
    """The first left row by all columns is also the first by those up to the last one shown."""
    spark.createDataFrame([("k", 2, "b", "p"), ("k", 1, "z", "q"), ("k", 1, "z", "a"), ("j", 0, "y", "r")], "k string, n int, s string, rest string").write.parquet(str(tmp_path / "left"))
    made = Engine(spark)
    made.register("o.l", spark.read.parquet(str(tmp_path / "left")))
    made.register("o.r", spark.createDataFrame([("k", 1), ("j", 2), ("j", 3)], "k string, m int"))
    frame = made.df("select s from o.l join select m from o.r")
    assert sorted(map(tuple, frame.collect())) == [("y", 2), ("y", 3), ("z", 1)]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:string,n:int,s:string>" in plan and "rest" not in plan
    assert sorted(map(tuple, made.df("select rest from o.l join select m from o.r").collect())) == [("a", 1), ("r", 2), ("r", 3)]


def test_table_ref_text():
    assert str(TableRef("a", "b")) == "a.b"
