import gzip
import subprocess
import sys
import time
from pathlib import Path

import pytest

from tests.library import SCHEMAS, TABLES, expected, lines, reader
from tests.test_engine import run
from tidemark.__main__ import Console, main
from tidemark import catalog
from tidemark.errors import QueryError
from tidemark.plans.ast import TableRef
from tidemark.session import Engine, cluster_session
from tidemark.streaming.feed import batch_writer, feed, rejects_folder, socket_stream, text_stream


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    made, folder = Engine(spark, buckets=3), tmp_path_factory.mktemp("text")
    for name in ("loans", "cards", "visits"):
        made.sql(f"CREATE TABLE ks.{name} {SCHEMAS[name]}")
        path = folder / f"{name}.txt"
        path.write_text("".join(line + "\n" for line in lines(name)))
        count, rejects = made.load(f"ks.{name}", str(path), "|")
        assert count == len(TABLES[name]) and rejects.count() == 0
    return made


def test_join_into_another_keyspace(stored, tmp_path):
    stored.sql("CREATE TABLE other.stays reader(UUID),branch(STRING),at(TIME)")
    (tmp_path / "a").write_text("".join(f"{reader(i)}|{branch}|2016-01-0{i + 1} 08:59:01\n" for i, branch in ((0, "barn"), (3, "quay"), (3, "ox"))))
    assert stored.load("other.stays", str(tmp_path / "a"), "|")[0] == 3
    joined = "select reader from ks.cards join select branch,at from ks.visits where at > '2016-02-10 00:00:00'"
    assert stored.sql(f"{joined} into other.stays").count == len(expected(joined)) > 1
    rows = [line.split("|")[:2] for line in expected(joined)] + [[reader(0), "barn"], [reader(3), "quay"], [reader(3), "ox"]]
    assert run(stored, "select reader,branch from other.stays") == ["|".join(r) for r in sorted(rows, key=lambda r: (r[0], len(r[1]), r[1]))]


def test_into_by_position_with_zero_values(stored):
    stored.sql("CREATE MEM TABLE other.wide title(STRING),reader(UUID),n(INT),t(TIME)")
    loans, cards = len(TABLES["loans"]), len(TABLES["cards"])
    assert stored.sql("select title from ks.loans union select reader from ks.cards into other.wide").count == loans + cards
    assert stored.sql("count other.wide where n=0 and t='1970-01-01 00:00:00'").count == loans + cards
    assert stored.sql("count other.wide where title=''").count == cards
    with pytest.raises(QueryError):
        stored.sql("select *,title,reader from other.wide into ks.cards")
    with pytest.raises(QueryError):
        stored.sql("select title from ks.loans into ks.nowhere")


def test_memory_tables_are_cached_in_each_session(spark, stored):
    stored.sql("CREATE MEM TABLE other.kept k(STRING),n(INT)")
    assert spark.catalog.isCached("other.kept")
    spark.catalog.uncacheTable("other.kept")  # as a new session finds it
    assert Engine(spark).sql("count other.kept").count == 0 and spark.catalog.isCached("other.kept")


def test_ddl(stored):
    assert "columns card(STRING),reader(UUID)" in stored.sql("describe ks.cards").info
    assert "loans" in stored.sql("DESCRIBE ks").info[0]
    assert any("ks" in line for line in stored.sql("describe").info)
    for bad in ("create table ks.cards a(INT)", "create table ks.bad a(FLOAT)", "create table ks.__mine a(INT)"):
        with pytest.raises(QueryError):
            stored.sql(bad)
    stored.sql("create table ks.gone a(BYTEARRAY[4]),b")
    assert stored.sql("select * from ks.gone").df.count() == 0 and stored.sql("count ks.gone").count == 0
    stored.sql("delete ks.gone")
    stored.sql("drop ks.gone")
    for bad in ("describe ks.gone", "delete ks.gone"):
        with pytest.raises(QueryError):
            stored.sql(bad)
    assert "5 buckets for new tables" in stored.sql("cluster numNodes 5").info and stored.sql("cluster numNodes 3").info
    assert stored.sql("close").closed and stored.sql("cluster down").closed and stored.sql("help").info
    rows = stored.sql("stats ks").df.collect()
    assert {r["table"] for r in rows} >= {"ks.loans", "ks.cards"} and all(r["segments"] > 0 and r["compressed"] > 0 and 0 <= r["region"] < 3 for r in rows)


@pytest.mark.parametrize("left", ["reader", "card"])
def test_hot_keys_of_a_placed_table_are_split(spark, stored, left, monkeypatch):
    """A key with a third of the rows is noted when it is written; a join gives it tasks of its own and shuffles nothing."""
    name = f"hot{left}"
    monkeypatch.setattr(catalog, "HOT_ROWS", 100)
    stored.sql(f"create table ks.{name} card(STRING),branch(STRING),at(TIME)")
    rows = [("C7", f"b{i}", None) for i in range(400)] + [(f"C{i}", "b", None) for i in range(1000)]
    for part in (rows[:700], rows[700:]):
        stored.catalog.append(TableRef("ks", name), spark.createDataFrame(part, "card string, branch string, at timestamp"))
    frame = stored.catalog.frame(TableRef("ks", name))
    assert frame.hot == ("C7",) and frame.placed == 3
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored.df(f"select {left} from ks.cards join select branch from ks.{name}")
        assert joined.count() == 401 + sum(c not in ("C7",) and int(c[1:]) < 1000 for c, _ in TABLES["cards"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        counted = stored.sql(f"count (select {left} from ks.cards join select branch from ks.{name})").count
        assert counted == joined.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    stored.sql(f"delete ks.{name}")
    assert stored.catalog.frame(TableRef("ks", name)).hot == ()


def test_unlike_bucket_counts_are_shuffled(spark, stored):
    other = Engine(spark, buckets=5)
    other.sql("create table ks.five card(STRING),branch(STRING)")
    other.sql("select card,branch from ks.visits into ks.five")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(run(other, "select reader from ks.cards join select branch from ks.five", False)) == sorted(line.rpartition("|")[0] for line in expected("select reader from k.cards join select branch,at from k.visits"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_join_has_no_exchange(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for left in ("reader", "card"):
            frame = stored.frame(f"select {left} from ks.cards join select branch from ks.visits").output()
            assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
            assert frame.count() == len(expected("select card from k.cards join select branch from k.visits"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pushdown_and_pruning(stored):
    plan = stored.frame("select branch from ks.visits where branch='mill'").output()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<branch:string>" in plan and "EqualTo(branch,mill)" in plan


def test_compaction_keeps_rows(stored):
    stored.sql("create table ks.many a(STRING),b(INT)")
    for _ in range(3):
        stored.sql("select card from ks.visits into ks.many")
    before = stored.catalog.stats("ks").where("table = 'ks.many'").agg({"segments": "sum"}).first()[0]
    stored.catalog.compact(TableRef("ks", "many"))
    after = stored.catalog.stats("ks").where("table = 'ks.many'").agg({"segments": "sum"}).first()[0]
    assert after < before and stored.sql("count ks.many").count == 45


def test_load_order_is_kept(spark, stored):
    stored.catalog.create(TableRef("ks", "asloaded"), "k(INT),v(INT)", ordered=False)
    stored.catalog.append(TableRef("ks", "asloaded"), spark.createDataFrame([(6, 1), (3, 2), (6, 0)], "k int, v int").coalesce(1))
    assert stored.sql("describe ks.asloaded").info[-1].endswith("in load order")
    with pytest.raises(QueryError):
        stored.catalog.compact(TableRef("ks", "asloaded"))
    assert [r["v"] for r in spark.table("ks.asloaded").where("k = 6").collect()] == [1, 0]


def test_tables_outlive_the_session(tmp_path):
    (tmp_path / "in").write_text("a\t1\nb\tx\nc\t3\n")
    run_cli = lambda *words: subprocess.run([sys.executable, "-m", "tidemark", "--cores", "2", "--warehouse", str(tmp_path / "w"), *words], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=300)
    assert run_cli("query", "create table p.t k(STRING),n(INT)").returncode == 0
    assert "2 records loaded, 1 rejected" in run_cli("load", "p.t", "--file", str(tmp_path / "in")).stdout
    assert run_cli("query", "select n,k from p.t where n > 1").stdout == "3\tc\n"


def test_rejects_trims_and_gzip(stored, tmp_path):
    stored.sql("create table ks.csv a(STRING),b(INT)")
    with gzip.open(tmp_path / "x.gz", "wt", newline="") as out:
        out.write("\r oak\t12\n\relm   \t 3400\r\n\nash\tx\nfir\nyew\t1\t2\n")
    count, rejects = stored.load("ks.csv", str(tmp_path / "x.gz"))
    assert count == 2 and sorted(r["fault"] for r in rejects.collect()) == ["b", "number of values", "number of values"]
    assert run(stored, "select * from ks.csv") == ["elm|3400", "oak|12"]


def test_one_value_to_a_line(stored, tmp_path):
    stored.sql("create table ks.stream uid(UUID),ts(LONG),c(STRING),v(STRING)")
    records = [(reader(1), i, "a", f"v{i}") for i in range(500)]
    (tmp_path / "s.txt").write_text("".join(f"{cell}\n" for r in records for cell in r) + "left\nover\n")
    assert stored.load("ks.stream", str(tmp_path / "s.txt"), "\n")[0] == 500
    assert {(r["ts"], r["v"]) for r in stored.df("select ts,v from ks.stream").collect()} == {(i, f"v{i}") for i in range(500)}
    (tmp_path / "mixed.txt").write_text(f"{reader(2)} 1 a\nx {reader(2)}\n2 b y\n")
    assert stored.load("ks.stream", str(tmp_path / "mixed.txt"), " ", layout="stream")[0] == 2


def test_other_tables_as_source(spark, stored):
    stored.sql("create table ks.hive at_id(STRING),n(INT),on(BOOL)")
    source = spark.createDataFrame([("a", "5", True, "d1"), (None, None, None, "d1"), ("b", "x", True, "d1"), ("c", "7", True, "d2")], "id string, num string, flag boolean, day string")
    count, rejects = stored.load_table("ks.hive", source, {"at_id": "id", "n": "num", "on": "flag"}, "day = 'd1'", "num is null or num <> '9'")
    assert count == 2 and rejects.count() == 1
    assert run(stored, "select * from ks.hive") == ["|0|false", "a|5|true"]


def test_feed(spark, stored, tmp_path):
    stored.sql("create table ks.feed at_id(STRING),n(INT)")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text("a\t1\nb\tx\n")
    for part in ("1", "2"):
        (tmp_path / "in" / part).write_text(f"a{part}\t1\nb\tx\n")
        query = feed(stored.catalog, TableRef("ks", "feed"), text_stream(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint"), available_now=True)
        query.awaitTermination()
    assert run(stored, "select * from ks.feed") == ["a1|1", "a2|1"]
    stored.sql("create table ks.json user_uid(UUID),t(TIME),kind(STRING)")
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "1").write_text(f'{{"userUid":"{reader(1)}","timestamp":1414768381000,"type":"page"}}\n{{"userUid":null,"timestamp":"x"}}\n')
    query = feed(stored.catalog, TableRef("ks", "json"), text_stream(spark, str(tmp_path / "json")), str(tmp_path / "checkpoint2"), json_paths={"user_uid": "$.userUid", "t": "$.timestamp", "kind": "$.type"}, available_now=True)
    query.awaitTermination()
    assert run(stored, "select * from ks.json") == [f"{reader(1)}|2014-10-31 15:13:01|page"]


def test_a_batch_that_comes_again_is_not_written_again(spark, stored, tmp_path):
    stored.sql("create table ks.once at_id(STRING),n(INT)")
    write = batch_writer(stored.catalog, TableRef("ks", "once"), str(tmp_path / "checkpoint"))
    batch = lambda *lines: spark.createDataFrame([(line,) for line in lines], "value string")
    for number, lines_of in ((0, ("a\t1", "b\tx")), (0, ("a\t1", "b\tx")), (1, ("c\t3",)), (1, ("c\t3",))):
        write(batch(*lines_of), number)
    assert run(stored, "select * from ks.once") == ["a|1", "c|3"]
    rejects = spark.read.parquet(rejects_folder(str(tmp_path / "checkpoint")))
    assert [(r["batch"], r["fault"], r["values"]) for r in rejects.collect()] == [(0, "n", ["b", "x"])]


def test_standard_input(spark, stored, monkeypatch):
    import io
    import types

    stored.sql("create table ks.piped k(STRING),n(INT)")
    for gzipped in (False, True):
        text = "x\t1\ny\t2\n".encode()
        monkeypatch.setattr(sys, "stdin", types.SimpleNamespace(buffer=io.BytesIO(gzip.compress(text) if gzipped else text)))
        assert stored.load("ks.piped", None, gzip=gzipped)[0] == 2
    assert run(stored, "select * from ks.piped") == ["x|1", "x|1", "y|2", "y|2"]


def test_socket(spark, stored, tmp_path):
    """Lines from a socket arrive in the table; the sender here waits for the receiver."""
    import socket
    import threading

    stored.sql("create table ks.sent k(STRING),n(INT)")
    server = socket.create_server(("127.0.0.1", 0))

    def send():
        connection, _ = server.accept()
        with connection:
            connection.sendall(b"x\t1\ny\t2\n")
            done.wait(60)

    done = threading.Event()
    threading.Thread(target=send, daemon=True).start()
    query = feed(stored.catalog, TableRef("ks", "sent"), socket_stream(spark, "127.0.0.1", server.getsockname()[1]), str(tmp_path / "checkpoint"))
    try:
        for _ in range(120):
            if stored.sql("count ks.sent").count == 2:
                break
            query.processAllAvailable()
            time.sleep(0.5)
        assert run(stored, "select * from ks.sent") == ["x|1", "y|2"]
    finally:
        done.set()
        query.stop()
        server.close()


def test_export_and_command_line(spark, stored, tmp_path, capsys):
    stored.sql("select card,branch from ks.visits").export(str(tmp_path / "out"), ";")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(f"{card};{branch}" for card, branch, _ in TABLES["visits"])
    assert main(["--separator", "|", "query", "select card from ks.cards where card='C105'"]) == 0
    assert main(["query", "select nothing"]) == 1
    (tmp_path / "more").write_text("C9|" + reader(1) + "\n")
    assert main(["--separator", "|", "load", "ks.cards", "--file", str(tmp_path / "more")]) == 0
    with pytest.raises(SystemExit):
        main(["--master", "spark://nowhere:7077", "query", "describe"])
    console = Console(stored)
    assert not console.onecmd("count ks.cards") and not console.onecmd("") and not console.onecmd("rubbish") and console.onecmd("close") and console.onecmd("EOF")
    shown = capsys.readouterr().out
    assert "C105" in shown and "1 records loaded, 0 rejected" in shown and "ERROR" in shown


def test_cluster_session_takes_its_settings(spark, tmp_path):
    """In a process with a session the builder hands that one out, with the settings that can still be set."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    again = cluster_session("local[2]", str(tmp_path), settings={"spark.sql.adaptive.enabled": "false"})
    assert again.conf.get("spark.sql.adaptive.enabled") == "false" and again.conf.get("spark.sql.session.timeZone") == "UTC"
    spark.conf.set("spark.sql.adaptive.enabled", before)
