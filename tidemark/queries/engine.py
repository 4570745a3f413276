"""Queries of the keyed engine over the test tables, written in the mini SQL, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import placement
from tidemark.functions.codecs import FieldType
from tidemark.plans.ast import TableRef
from tidemark.plans.filters import FilterBuilder, predicate_column, where
from tidemark.plans.lower import Options
from tidemark.session import Engine
from tidemark.sources.shared import scratch
from tidemark.sources.tables import table
from tidemark.streaming.feed import feed, text_stream

#: Keyed views of the test tables: the key comes first.
KEYED = {
    "customer": ("customer", None),
    "nation": ("nation", None),
    "part": ("part", None),
    "documents": ("documents", ("doc_id", "text", "lang", "source", "n_chars")),
    "orders": ("orders", ("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    "lineitem": ("lineitem", ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")),
    "events": ("events", ("user_id", "event_id", "ts", "event_type", "value")),
    "views": ("views", None),
    "syncs": ("syncs", None),
    "flags": ("flags", None),
}


def engine(spark: SparkSession, d: str, options: Options = Options()) -> Engine:
    made = Engine(spark, options=options)
    for name, (stored, columns) in KEYED.items():
        rows = table(spark, d, stored)
        made.register(f"t.{name}", rows.select(*columns) if columns else rows)
    return made


#: name: (statement, SQL)
STATEMENTS = {
    "scan_project": ("select c_name,c_custkey from t.customer", "SELECT c_name, c_custkey FROM customer"),
    "scan_wildcard": ("select * from t.part", "SELECT * FROM part"),
    "project_dup": ("select *,c_name,c_name from t.customer", "SELECT * FROM customer"),
    "filter_eq": ("select c_custkey,c_mktsegment from t.customer where c_mktsegment='BUILDING'", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_gt": ("select c_custkey,c_acctbal from t.customer where c_acctbal > 5000", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000"),
    "filter_lt": ("select l_orderkey,l_linenumber from t.lineitem where l_linenumber < 3", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 3"),
    "filter_time_gt": (
        "select at_id,url from t.views where timestamp > '2014-11-20 16:00:00'",
        "SELECT at_id, url FROM views WHERE \"timestamp\" > TIMESTAMPTZ '2014-11-20 16:00:00+00'",
    ),
    "filter_negative": ("select c_custkey,c_acctbal from t.customer where c_acctbal > -250 and c_custkey > -7", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > -250 AND c_custkey > -7"),
    "filter_contains": ("select doc_id,lang from t.documents where text contains 'retry'", "SELECT doc_id, lang FROM documents WHERE contains(text, 'retry')"),
    "filter_in": ("select c_custkey,c_nationkey from t.customer where c_nationkey in (3, 7, 11)", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (3, 7, 11)"),
    "filter_not": (
        "select p_partkey,p_size from t.part where p_size not > 10 and p_partkey not in (1,2,3)",
        "SELECT p_partkey, p_size FROM part WHERE NOT p_size > 10 AND p_partkey NOT IN (1, 2, 3)",
    ),
    "filter_and_or_right": (
        "select p_partkey,p_size from t.part where p_size < 20 and p_size > 10 or p_partkey < 50",
        "SELECT p_partkey, p_size FROM part WHERE p_size < 20 AND (p_size > 10 OR p_partkey < 50)",
    ),
    "filter_or_and": (
        "select p_partkey,p_size from t.part where p_size < 5 or p_size > 10 and p_partkey < 50",
        "SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR (p_size > 10 AND p_partkey < 50)",
    ),
    "filter_string_shortlex": (
        "select n_nationkey,n_name from t.nation where n_name > 'FRANCE'",
        "SELECT n_nationkey, n_name FROM nation WHERE strlen(n_name) > 6 OR (strlen(n_name) = 6 AND n_name > 'FRANCE')",
    ),
    "count_table": ("count t.lineitem", 'SELECT count(*) AS "count" FROM lineitem'),
    "count_where": ("count t.lineitem where l_returnflag='R'", "SELECT count(*) AS \"count\" FROM lineitem WHERE l_returnflag = 'R'"),
    "count_frame": ("count (select o_orderkey from t.orders where o_totalprice > 100000)", 'SELECT count(*) AS "count" FROM orders WHERE o_totalprice > 100000'),
    "count_frame_where": (
        "count (select o_orderkey,o_orderstatus from t.orders where o_totalprice > 100000) where o_orderstatus='F'",
        "SELECT count(*) AS \"count\" FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
    ),
    "count_union": ("count (select * from t.customer union select * from t.orders)", 'SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS "count"'),
    "count_join": (
        "count (select at_id from t.syncs join select at_id from t.views)",
        'SELECT count(*) AS "count" FROM views WHERE at_id IN (SELECT at_id FROM syncs WHERE at_id IS NOT NULL)',
    ),
    "count_intersection": (
        "count (select c_custkey from t.customer where c_mktsegment='BUILDING' intersection select o_custkey from t.orders)",
        """SELECT (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders))
+ (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS "count\"""",
    ),
    "join_keyed": (
        "select c_name from t.customer where c_mktsegment='BUILDING' join select o_orderkey,o_totalprice from t.orders",
        "SELECT c_name, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "join_dup_left": (
        "select o_orderkey,o_totalprice from t.orders join select c_custkey,c_name from t.customer",
        """SELECT o_orderkey, o_totalprice, c_custkey, c_name FROM customer
JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) o ON o_custkey = c_custkey AND place = 1""",
    ),
    "join_semi_filter": (
        "select c_custkey from t.customer where c_nationkey < 5 join select o_orderkey from t.orders",
        "SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)",
    ),
    "join_first_sync": (
        "select vdna_user_id from t.syncs join select url,useragent from t.views",
        """SELECT vdna_user_id, url, useragent FROM views v JOIN (SELECT *, row_number() OVER (PARTITION BY at_id
ORDER BY strlen(vdna_user_id) NULLS FIRST, vdna_user_id NULLS FIRST, "timestamp" NULLS FIRST) AS place FROM syncs) s ON s.at_id = v.at_id AND place = 1""",
    ),
    "union_outer": (
        "select c_custkey,c_name from t.customer union select o_orderkey,o_totalprice from t.orders",
        "SELECT c_custkey, c_name, NULL AS o_orderkey, NULL AS o_totalprice FROM customer UNION ALL SELECT NULL, NULL, o_orderkey, o_totalprice FROM orders",
    ),
    "intersection_keyed": (
        "select c_custkey,c_name from t.customer where c_acctbal > 0 intersection select o_custkey,o_orderkey from t.orders where o_orderstatus='P'",
        """SELECT c_custkey, c_name, NULL AS o_custkey, NULL AS o_orderkey FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT NULL, NULL, o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    ),
    "nested_right_assoc": (
        "select c_custkey from t.customer where c_nationkey < 10 join select o_orderkey from t.orders union select user_id,event_id from t.events",
        """SELECT r.k AS c_custkey, o_orderkey, user_id, event_id FROM (SELECT o_custkey AS k, o_orderkey, NULL AS user_id, NULL AS event_id FROM orders
UNION ALL SELECT user_id, NULL, user_id, event_id FROM events) r WHERE k IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)""",
    ),
    "subquery_filter": (
        "select o_orderkey from (select o_orderkey,o_totalprice from t.orders where o_orderstatus='O') where o_totalprice < 50000",
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 50000",
    ),
    "usecase1_training_set": (
        "select c_custkey from t.customer where c_acctbal > 0 and c_mktsegment='BUILDING' or c_mktsegment='MACHINERY' join "
        "(select o_custkey,o_orderkey,o_orderdate from t.orders where o_orderpriority contains 'URGENT' union select user_id,event_id,event_type from t.events where event_type='purchase')",
        """SELECT r.k AS c_custkey, o_custkey, o_orderkey, o_orderdate, user_id, event_id, event_type FROM (
SELECT o_custkey AS k, o_custkey, o_orderkey, o_orderdate, NULL AS user_id, NULL AS event_id, NULL AS event_type FROM orders WHERE contains(o_orderpriority, 'URGENT')
UNION ALL SELECT user_id, NULL, NULL, NULL, user_id, event_id, event_type FROM events WHERE event_type = 'purchase') r
WHERE k IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY'))""",
    ),
    "usecase2_rekey": (
        "select vdna_user_id from t.syncs where timestamp > '2014-10-15 00:00:00' join select url from t.views where url contains 'holiday'",
        """SELECT vdna_user_id, url FROM views v JOIN (SELECT *, row_number() OVER (PARTITION BY at_id
ORDER BY strlen(vdna_user_id) NULLS FIRST, vdna_user_id NULLS FIRST, "timestamp" NULLS FIRST) AS place FROM syncs
WHERE "timestamp" > TIMESTAMPTZ '2014-10-15 00:00:00+00') s ON s.at_id = v.at_id AND place = 1 WHERE contains(url, 'holiday')""",
    ),
}


def _statement(text: str):
    return lambda spark, d: engine(spark, d).df(text)


def filter_builder(spark: SparkSession, d: str) -> DataFrame:
    chain = where("p_size").greater_than(40).and_("p_name").contains("a").or_("p_partkey").in_(1, 2, 3)
    frame = engine(spark, d).frame("select p_partkey,p_size,p_name from t.part")
    return frame.filter(predicate_column(chain.predicate, list(frame.fields))).output()


def filter_sql_precedence(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, Options(precedence="sql")).df("select p_partkey from t.part where p_size < 20 and p_size > 10 or p_partkey < 50")


def rows_as_text(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).frame("select n_nationkey,n_name from t.nation").as_text("|")


def rows_grouped_by_key(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).frame("select o_orderkey from t.orders").grouped(F.min("o_orderkey").alias("first_order"))


def rows_ordered(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d).frame("select n_name,n_regionkey from t.nation").output(ordered=True)


def _places(ordered: DataFrame) -> DataFrame:
    """The rows of a small result with their places in it."""
    return ordered.withColumn("place", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("place")))


def rows_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Strings by length first: the key is a name here."""
    made = engine(spark, d).register("t.named", table(spark, d, "nation").select("n_name", "n_nationkey"))
    return _places(made.frame("select n_nationkey from t.named").output(ordered=True))


def rows_descending(spark: SparkSession, d: str) -> DataFrame:
    made = engine(spark, d).register("t.named", table(spark, d, "nation").select("n_name", "n_nationkey"))
    return _places(made.frame("select n_name from t.named").output(descending=True))


def filter_text(spark: SparkSession, d: str) -> DataFrame:
    """A filter from its own text, and the columns it names."""
    chain = FilterBuilder.from_text(str(where("p_size").greater_than(40).and_("p_name").not_().contains("a").or_("p_partkey").in_(1, 2, 3)))
    frame = engine(spark, d).frame(f"select {','.join(chain.fields)} from t.part")
    return frame.filter(predicate_column(chain.predicate, list(frame.fields))).output()


def filter_escaped(spark: SparkSession, d: str) -> DataFrame:
    name, size = FieldType("STRING").escape("green"), FieldType("INT").escape("7")
    return engine(spark, d).df(f"select p_partkey from t.part where p_name contains {name} or p_size = {size}")


def join_across_keyspaces(spark: SparkSession, d: str) -> DataFrame:
    """Stored tables of two keyspaces with as many buckets, joined by key."""
    made, space, _ = _stored(spark, d)
    made.sql(f"create table {space}.people c_custkey(LONG),c_name(STRING)")
    made.sql(f"create table {space}far.orders o_custkey(LONG),o_orderkey(LONG)")
    made.sql(f"select c_custkey,c_name from t.customer where c_mktsegment='BUILDING' into {space}.people")
    made.sql(f"select o_custkey,o_orderkey from t.orders into {space}far.orders")
    return made.df(f"select c_name from {space}.people join select o_orderkey from {space}far.orders")


def codec_int_long(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with a sign, with a letter behind, too large, empty."""
    key = F.col("l_orderkey").cast("string")
    kinds = [F.concat(F.lit("-"), key), F.concat(key, F.lit("x")), F.concat(key, F.lit("00000000")), F.lit("")]
    text = F.coalesce(*(F.when(F.col("l_linenumber") == i + 1, k) for i, k in enumerate(kinds)), key)
    return table(spark, d, "lineitem").select(text.alias("text"), FieldType("INT").parse(text).alias("as_int"), FieldType("LONG").parse(text).alias("as_long"))


def codec_string_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Text as it is, and as bytes where it is of that length."""
    kind = FieldType("BYTEARRAY", 6)
    return table(spark, d, "nation").select("n_name", FieldType("STRING").parse(F.when(F.col("n_regionkey") > 0, F.col("n_name"))).alias("as_text"), kind.render(kind.parse(F.col("n_name"))).alias("as_bytes"))


def placements(spark: SparkSession, d: str) -> DataFrame:
    """Partitions of keys of the other types."""
    orders, large = table(spark, d, "orders"), (F.col("o_orderkey") - 5000) * F.lit(1_000_003)
    parts = {
        "by_int": ("INT", -F.col("o_custkey").cast("int")),
        "by_long": ("LONG", large),
        "by_time": ("TIME", F.timestamp_millis(F.col("o_orderkey") * F.lit(86_400_123))),
        "by_bool": ("BOOL", F.col("o_totalprice") > 100_000),
        "by_bytes": ("BYTEARRAY", F.encode("o_orderpriority", "UTF-8")),
    }
    return orders.select("o_orderkey", *(placement.partition(FieldType(kind), value, 5).alias(name) for name, (kind, value) in parts.items()))


def _counted(spark: SparkSession, *counts: int) -> DataFrame:
    return spark.createDataFrame([tuple(counts)], ", ".join(f"n_{i} long" for i in range(len(counts))))


def codec_uuid(spark: SparkSession, d: str) -> DataFrame:
    kind = FieldType("UUID")
    return table(spark, d, "flags").select("user_uid", kind.render(kind.parse(F.col("user_uid"))).alias("rendered"))


def codec_ipv4(spark: SparkSession, d: str) -> DataFrame:
    kind = FieldType("IPV4")
    text = kind.render(F.col("client_ip"))
    return table(spark, d, "event_log").select("client_ip", text.alias("rendered"), kind.parse(text).alias("parsed"))


def codec_time(spark: SparkSession, d: str) -> DataFrame:
    kind = FieldType("TIME")
    text = kind.render(F.col("timestamp"))
    return table(spark, d, "event_log").select(text.alias("rendered"), F.unix_millis(kind.parse(text)).alias("parsed_ms"))


def codec_bool_byte(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", FieldType("BOOL").parse(size).alias("as_bool"), FieldType("BYTE").parse(F.concat(size, F.lit("5"))).cast("int").alias("as_byte"))


def partition_uuid(spark: SparkSession, d: str) -> DataFrame:
    user = FieldType("UUID").parse(F.col("user_uid"))
    placed = table(spark, d, "flags").select(placement.partition(FieldType("UUID"), user, 4).alias("region"))
    return placed.where(F.col("region").isNotNull()).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def partition_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name", placement.checksum(F.col("n_name")).alias("checksum"), placement.partition(FieldType("STRING"), F.col("n_name"), 4).alias("region"))


def _stored(spark: SparkSession, d: str) -> tuple[Engine, str, str]:
    """An engine whose tables lie in the shared folder, a new keyspace, and a folder for its files."""
    folder = scratch(spark, "store")
    made = Engine(spark, location=folder)
    for name, (stored, columns) in KEYED.items():
        rows = table(spark, d, stored)
        made.register(f"t.{name}", rows.select(*columns) if columns else rows)
    return made, "s" + folder.rpartition("-")[2], folder


def select_into(spark: SparkSession, d: str) -> DataFrame:
    """The keyed join INTO a table of another keyspace, then that table."""
    made, space, _ = _stored(spark, d)
    made.sql(f"create table {space}.pages user_id(STRING),url(STRING)")
    made.sql(f"select vdna_user_id from t.syncs join select url from t.views into {space}.pages")
    return made.df(f"select * from {space}.pages")


def into_counts(spark: SparkSession, d: str) -> DataFrame:
    """What INTO returns, twice, and then the table's own count."""
    made, space, _ = _stored(spark, d)
    made.sql(f"create mem table {space}.pages user_id(STRING),url(STRING)")
    into = f"select vdna_user_id from t.syncs join select url from t.views into {space}.pages"
    return _counted(spark, made.sql(into).count, made.sql(into).count, made.sql(f"count {space}.pages").count)


def table_life(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a table after loading, in another engine, after DELETE; and whether DROP leaves it."""
    made, space, _ = _stored(spark, d)
    made.sql(f"create table {space}.names id(LONG),name(STRING)")
    made.sql(f"select c_custkey,c_name from t.customer into {space}.names")
    again = Engine(spark)
    counts = [made.sql(f"count {space}.names").count, again.sql(f"count {space}.names where id > -1").count]
    again.sql(f"delete {space}.names")
    counts.append(made.sql(f"count {space}.names").count)
    made.sql(f"drop {space}.names")
    return _counted(spark, *counts, int(again.catalog.exists(TableRef(space, "names"))))


PARTS = "p_partkey(BYTE),p_size(INT),p_name(STRING)"


def _exported(spark: SparkSession, d: str) -> tuple[Engine, str, str]:
    made, space, folder = _stored(spark, d)
    made.sql("select p_partkey,p_size,p_name from t.part").export(f"{folder}/text", compression="gzip")
    made.sql(f"create table {space}.parts {PARTS}")
    return made, space, folder


def load_text(spark: SparkSession, d: str) -> DataFrame:
    """Exported, compressed text loaded into a table; keys above 255 are no BYTE and rejected."""
    made, space, folder = _exported(spark, d)
    made.load(f"{space}.parts", f"{folder}/text")
    return made.df(f"select p_partkey,p_size,p_name from {space}.parts").withColumn("p_partkey", F.col("p_partkey").cast("int"))


def load_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a load returns, and its rejects."""
    made, space, folder = _exported(spark, d)
    count, rejects = made.load(f"{space}.parts", f"{folder}/text")
    return _counted(spark, count, rejects.count())


def load_values_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Text with a value to a line, every three lines a record."""
    made, space, folder = _stored(spark, d)
    made.sql("select c_custkey,c_name,c_nationkey from t.customer").export(f"{folder}/values", separator="\n")
    made.sql(f"create table {space}.people c_custkey(LONG),c_name(STRING),c_nationkey(INT)")
    made.load(f"{space}.people", f"{folder}/values", separator="\n")
    return made.df(f"select * from {space}.people")


def load_rejects(spark: SparkSession, d: str) -> DataFrame:
    made, space, folder = _exported(spark, d)
    _, rejects = made.load(f"{space}.parts", f"{folder}/text")
    return rejects.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The same text as a stream of files, appended batch by batch."""
    made, space, folder = _exported(spark, d)
    feed(made.catalog, TableRef(space, "parts"), text_stream(spark, f"{folder}/text"), f"{folder}/progress", available_now=True).awaitTermination()
    return made.df(f"count {space}.parts")


def load_other_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows of another table by a column mapping and filters."""
    made, space, _ = _stored(spark, d)
    made.sql(f"create table {space}.names id(LONG),name(STRING),nation(INT)")
    made.load_table(f"{space}.names", table(spark, d, "customer"), {"id": "c_custkey", "name": "upper(c_name)", "nation": "c_nationkey"}, "c_nationkey < 10", "c_acctbal > 0")
    return made.df(f"select * from {space}.names")


def stats_and_description(spark: SparkSession, d: str) -> DataFrame:
    """What STATS, DESCRIBE and compaction say of a table that was loaded twice."""
    made, space, folder = _exported(spark, d)
    for _ in range(2):
        made.load(f"{space}.parts", f"{folder}/text")
    stats = lambda: made.sql(f"stats {space}").df.agg(F.sum("segments"), F.min("compressed"), F.max("region")).first()
    before = stats()
    made.catalog.compact(TableRef(space, "parts"))
    after = stats()
    schema = next(x for x in made.sql(f"describe {space}.parts").info if x.startswith("columns"))
    said = [(schema, before[0] > after[0] > 0, after[1] > 0, 0 <= after[2] < made.catalog.buckets, made.sql(f"count {space}.parts").count)]
    return spark.createDataFrame(said, "described string, compacted boolean, has_size boolean, has_region boolean, n long")


_EXTRA = (rows_in_order, rows_descending, filter_text, filter_escaped, join_across_keyspaces, codec_int_long, codec_string_bytes, placements, into_counts, table_life, load_counts, load_values_of_lines, select_into, load_text, load_rejects, stream_ingest, load_other_table, stats_and_description, filter_builder, filter_sql_precedence, rows_as_text, rows_grouped_by_key, rows_ordered, codec_uuid, codec_ipv4, codec_time, codec_bool_byte, partition_uuid, partition_string)
QUERIES = {name: _statement(text) for name, (text, _) in STATEMENTS.items()} | {f.__name__: f for f in _EXTRA}

_CANONICAL = "lower(" + " || '-' || ".join(f"substr(user_uid, {a}, {n})" for a, n in ((1, 8), (10, 4), (15, 4), (20, 4), (25, 12))) + ")"
_SHAPE = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
_PARSED = f"CASE WHEN coalesce(user_uid, '') = '' THEN '00000000-0000-0000-0000-000000000000' WHEN length(user_uid) = 36 AND regexp_matches({_CANONICAL}, '{_SHAPE}') THEN {_CANONICAL} END"
_WORDS = [f"CAST('0x' || substr(replace(u, '-', ''), {1 + 8 * i}, 8) AS BIGINT)" for i in range(4)]
_MIXED = f"xor(xor({_WORDS[0]}, {_WORDS[1]}), xor({_WORDS[2]}, {_WORDS[3]}))"

#: 16-bit reflected checksum of ASCII text, eight shifts for each byte.
_CHECKSUM = """list_reduce(list_prepend(65535, list_transform(string_split(n_name, ''), lambda c: ascii(c))),
lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 40961)))"""
_NUMBER = "CASE l_linenumber WHEN 1 THEN '-' || l_orderkey WHEN 2 THEN l_orderkey || 'x' WHEN 3 THEN l_orderkey || '00000000' WHEN 4 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END"
_PAGES = "SELECT count(*) AS n FROM views WHERE at_id IN (SELECT at_id FROM syncs WHERE at_id IS NOT NULL)"
_LOW = "CASE WHEN ({v} & 4294967295) >= 2147483648 THEN ({v} & 4294967295) - 4294967296 ELSE {v} & 4294967295 END"
_MOD = "CAST((({v}) % 5 + 5) % 5 AS INTEGER)"

SQL = {name: sql for name, (_, sql) in STATEMENTS.items()} | {
    "rows_in_order": "SELECT n_nationkey, row_number() OVER (ORDER BY strlen(n_name), n_name) AS place FROM nation",
    "rows_descending": "SELECT n_name, row_number() OVER (ORDER BY strlen(n_name) DESC, n_name DESC) AS place FROM nation",
    "filter_text": "SELECT p_size, p_name, p_partkey FROM part WHERE p_size > 40 AND (NOT contains(p_name, 'a') OR p_partkey IN (1, 2, 3))",
    "filter_escaped": "SELECT p_partkey FROM part WHERE contains(p_name, 'green') OR p_size = 7",
    "join_across_keyspaces": "SELECT c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "codec_int_long": f"""SELECT text, CASE WHEN text = '' THEN 0 WHEN regexp_matches(text, '^-?[0-9]+$') THEN TRY_CAST(text AS INTEGER) END AS as_int,
CASE WHEN text = '' THEN 0 WHEN regexp_matches(text, '^[0-9]+$') THEN TRY_CAST(text AS BIGINT) END AS as_long FROM (SELECT {_NUMBER} AS text FROM lineitem)""",
    "codec_string_bytes": "SELECT n_name, CASE WHEN n_regionkey > 0 THEN n_name ELSE '' END AS as_text, CASE WHEN strlen(n_name) = 6 THEN n_name END AS as_bytes FROM nation",
    "placements": f"""SELECT o_orderkey, CAST(o_custkey % 5 AS INTEGER) AS by_int, {_MOD.format(v=_LOW.format(v="((o_orderkey - 5000) * 1000003)"))} AS by_long,
{_MOD.format(v=_LOW.format(v="(o_orderkey * 86400123)"))} AS by_time, CAST(o_totalprice > 100000 AS INTEGER) AS by_bool,
CAST(list_reduce(list_prepend(0, list_transform(string_split(o_orderpriority, ''), lambda c: ascii(c))), lambda s, b: xor(s, b)) % 5 AS INTEGER) AS by_bytes FROM orders""",
    "partition_string": f"SELECT n_name, CAST({_CHECKSUM} AS BIGINT) AS checksum, CAST(abs({_CHECKSUM}) % 4 AS INTEGER) AS region FROM nation",
    "into_counts": f"SELECT n AS n_0, n AS n_1, 2 * n AS n_2 FROM ({_PAGES})",
    "table_life": "SELECT count(*) AS n_0, count(*) AS n_1, 0 AS n_2, 0 AS n_3 FROM customer",
    "load_counts": "SELECT count_if(p_partkey <= 255) AS n_0, count_if(p_partkey > 255) AS n_1 FROM part",
    "load_values_of_lines": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "select_into": """SELECT coalesce(vdna_user_id, '') AS user_id, coalesce(url, '') AS url FROM views v JOIN (SELECT *, row_number() OVER (PARTITION BY at_id
ORDER BY strlen(vdna_user_id) NULLS FIRST, vdna_user_id NULLS FIRST, "timestamp" NULLS FIRST) AS place FROM syncs) s ON s.at_id = v.at_id AND place = 1""",
    "load_text": "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_size, p_name FROM part WHERE p_partkey <= 255",
    "load_rejects": "SELECT 'p_partkey' AS fault, count(*) AS n FROM part WHERE p_partkey > 255 HAVING count(*) > 0",
    "stream_ingest": 'SELECT count(*) AS "count" FROM part WHERE p_partkey <= 255',
    "load_other_table": "SELECT c_custkey AS id, upper(c_name) AS name, c_nationkey AS nation FROM customer WHERE c_nationkey < 10 AND c_acctbal > 0",
    "stats_and_description": f"SELECT 'columns {PARTS}' AS described, true AS compacted, true AS has_size, true AS has_region, 2 * count(*) AS n FROM part WHERE p_partkey <= 255",
    "filter_builder": "SELECT p_partkey, p_size, p_name FROM part WHERE p_size > 40 AND (contains(p_name, 'a') OR p_partkey IN (1, 2, 3))",
    "filter_sql_precedence": "SELECT p_partkey FROM part WHERE (p_size < 20 AND p_size > 10) OR p_partkey < 50",
    "rows_as_text": "SELECT n_nationkey || '|' || n_name AS line FROM nation",
    "rows_grouped_by_key": 'SELECT o_custkey AS "key", count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey',
    "rows_ordered": "SELECT n_name, n_regionkey FROM nation ORDER BY n_nationkey",
    "codec_uuid": f"SELECT user_uid, {_PARSED} AS rendered FROM flags",
    "codec_ipv4": """SELECT client_ip, (client_ip >> 24) || '.' || ((client_ip >> 16) & 255) || '.' || ((client_ip >> 8) & 255) || '.' || (client_ip & 255) AS rendered,
coalesce(client_ip, 0) AS parsed FROM event_log""",
    "codec_time": """SELECT strftime(make_timestamp(epoch_us("timestamp")), '%Y-%m-%d %H:%M:%S') AS rendered,
coalesce(epoch_us("timestamp") // 1000000 * 1000, 0) AS parsed_ms FROM event_log""",
    "codec_bool_byte": """SELECT p_partkey, length(CAST(p_size AS VARCHAR)) = 4 OR (length(CAST(p_size AS VARCHAR)) = 1 AND p_size <> 0) AS as_bool,
CASE WHEN p_size * 10 + 5 <= 255 THEN CAST(p_size * 10 + 5 AS INTEGER) END AS as_byte FROM part""",
    "partition_uuid": f"""SELECT CAST(abs(CASE WHEN m >= 2147483648 THEN m - 4294967296 ELSE m END) % 4 AS INTEGER) AS region, count(*) AS n
FROM (SELECT {_MIXED} AS m FROM (SELECT {_PARSED} AS u FROM flags) WHERE u IS NOT NULL) GROUP BY ALL""",
}
