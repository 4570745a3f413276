"""Queries of the general problems over the keyed event tables, with their SQL."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import reading
from tidemark.operators import features, orphans, rolling, sessions, skew
from tidemark.sources.tables import table

FIRST_DAY, LAST_DAY = date(2014, 10, 1), date(2014, 11, 30)
GAP_MS = 1_800_000
LAPSED_MS = int(datetime(2014, 11, 16, tzinfo=timezone.utc).timestamp() * 1000)


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(table(spark, d, "event_log"), GAP_MS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_sessions(spark, d).select("user_uid", "start_ms")


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_totals(table(spark, d, "event_log"), FIRST_DAY, LAST_DAY, (7, 30))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    burst = (F.col("n_records") == 0) & (F.col("total_30d") >= 20) & (F.col("total_7d") * 10 >= F.col("total_30d") * 7)
    return p2_rolling(spark, d).where(burst).select("user_uid", "day_utc")


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    """The wide rows as text, ``type:count:total:last`` in order of type, so that any engine can compare them."""
    wide = features.feature_table(table(spark, d, "event_log"))
    cells = F.transform(
        F.arrays_zip("types", "counts", "totals", "last_ms"),
        lambda f: F.concat_ws(":", f["types"], f["counts"].cast("string"), f["totals"].cast("string"), F.coalesce(f["last_ms"].cast("string"), F.lit("-"))),
    )
    return wide.select("user_uid", "n_records", F.size("types").cast("long").alias("n_types"), F.array_join(cells, ";").alias("features"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = features.feature_pairs(features.feature_table(table(spark, d, "event_log")))
    return pairs.where((F.col("n_timed") >= 5) & (F.col("last_ms") < LAPSED_MS)).select("user_uid", "event_type")


SKEWED = (("views", "at_id"), ("event_log", "api_key"))


def _skewed(spark: SparkSession, d: str, share: float | None) -> DataFrame:
    parts = []
    for name, field in SKEWED:
        rows, key, ms = table(spark, d, name), reading.text_key(F.col(field)), reading.to_ms(reading.instant_us(F.col("timestamp")))
        result = skew.per_key_totals(rows, key, ms) if share is None else skew.heavy_keys(rows, key, ms, share)
        parts.append(result.select(F.lit(name).alias("src_table"), F.lit(field).alias("field_name"), F.col("key").alias("item"), "n_rows", "n_timed", "first_ms", "last_ms"))
    return parts[0].unionByName(parts[1])


def p6_per_key(spark: SparkSession, d: str) -> DataFrame:
    return _skewed(spark, d, None)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _skewed(spark, d, 0.02).select("src_table", "field_name", "item")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    us = reading.instant_us(F.col("timestamp"))
    syncs, flags = table(spark, d, "syncs"), table(spark, d, "flags")
    at_id, user = reading.text_key(F.col("at_id")), reading.user_id(F.col("vdna_user_id"))
    deletes = (F.lower(F.trim("flag")) == "deleted") & F.col("flag_value")
    synced = orphans.validity_intervals(syncs, at_id, us)
    flagged = orphans.validity_intervals(flags, reading.user_id(F.col("user_uid")), us, deletes)
    views_of = orphans.orphan_references(table(spark, d, "views"), at_id, us, synced).withColumns({"src_table": F.lit("views"), "ref_field": F.lit("at_id")})
    syncs_of = orphans.orphan_references(syncs, user, us, flagged).withColumns({"src_table": F.lit("syncs"), "ref_field": F.lit("vdna_user_id")})
    return views_of.unionByName(syncs_of).withColumns({"day_utc": reading.day_text(F.col("us"))})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "ref_field", F.col("key").alias("ref_key"), "day_utc").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references and distinct orphan keys per table, day and verdict."""
    per_key = _orphans(spark, d).groupBy("src_table", "ref_field", "day_utc", "verdict", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("src_table", "ref_field", "day_utc", "verdict").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))


QUERIES = {f.__name__: f for f in (p1_sessions, p1_found, p2_rolling, p2_found, p5_features, p5_found, p6_per_key, p6_found, p7_report, p7_found)}


def _user(column: str) -> str:
    canonical = "lower(" + " || '-' || ".join(f"substr(trim({column}), {a}, {n})" for a, n in ((1, 8), (10, 4), (15, 4), (20, 4), (25, 12))) + ")"
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return f"CASE WHEN length(trim({column})) = 36 AND regexp_matches({canonical}, '{shape}') AND {canonical} <> '{reading.NIL_UUID}' THEN {canonical} END"


def _text(column: str) -> str:
    return f"nullif(trim({column}, ' ' || chr(13)), '')"


_US = "nullif(epoch_us(\"timestamp\"), 0)"
_DAY = "strftime(make_timestamp(us), '%Y-%m-%d')"
RECORDS = f"""SELECT DISTINCT {_user("user_uid")} AS uid, {_US} AS us, nullif(lower(trim(event_type)), '') AS kind, url
FROM event_log WHERE {_user("user_uid")} IS NOT NULL"""
_SESSIONS = f"""WITH r AS ({RECORDS}), t AS (SELECT uid, us // 1000 AS ms, count(*) AS n FROM r WHERE us IS NOT NULL GROUP BY ALL),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY uid ORDER BY ms) <= {GAP_MS} THEN 0 ELSE 1 END AS fresh FROM t),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY uid ORDER BY ms ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT uid AS user_uid, CAST(min(ms) AS BIGINT) AS start_ms, CAST(max(ms) AS BIGINT) AS end_ms, CAST(max(ms) - min(ms) AS BIGINT) AS duration_ms, CAST(sum(n) AS BIGINT) AS n_records
FROM s GROUP BY uid, session"""
_ROLLING = f"""WITH r AS ({RECORDS}), c AS (SELECT uid, CAST(make_timestamp(us) AS DATE) AS day, count(*) AS n FROM r WHERE us IS NOT NULL GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY)) AS DATE) AS day),
grid AS (SELECT u.uid, days.day, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT uid FROM r) u CROSS JOIN days LEFT JOIN c ON c.uid = u.uid AND c.day = days.day),
w AS (SELECT uid, day, n, sum(n) OVER (PARTITION BY uid ORDER BY day ROWS 6 PRECEDING) AS t7, sum(n) OVER (PARTITION BY uid ORDER BY day ROWS 29 PRECEDING) AS t30 FROM grid)
SELECT uid AS user_uid, strftime(day, '%Y-%m-%d') AS day_utc, CAST(n AS BIGINT) AS n_records, CAST(t7 AS BIGINT) AS total_7d, t7 / 7.0::DOUBLE AS average_7d,
CAST(t30 AS BIGINT) AS total_30d, t30 / 30.0::DOUBLE AS average_30d FROM w"""
_PAIRS = f"""WITH r AS ({RECORDS}) SELECT uid, kind, count(us) AS timed, count(*) AS total, max(us) // 1000 AS last FROM r WHERE kind IS NOT NULL GROUP BY ALL"""
_TOTALS = " UNION ALL ".join(
    f"""SELECT '{name}' AS src_table, '{field}' AS field_name, {_text(field)} AS item, count(*) AS n_rows, count({_US}) AS n_timed,
min({_US}) // 1000 AS first_ms, max({_US}) // 1000 AS last_ms FROM {name} GROUP BY ALL"""
    for name, field in SKEWED
)
_HEAVY = " UNION ALL ".join(
    f"""SELECT '{name}' AS src_table, '{field}' AS field_name, {_text(field)} AS item FROM {name} WHERE {_text(field)} IS NOT NULL
GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM {name})"""
    for name, field in SKEWED
)
_ORPHANS = f"""WITH p1 AS (SELECT {_text("at_id")} AS k, min({_US}) AS since, CAST(NULL AS BIGINT) AS until FROM syncs GROUP BY ALL),
p2 AS (SELECT {_user("user_uid")} AS k, min({_US}) AS since, min({_US}) FILTER (lower(trim(flag)) = 'deleted' AND flag_value) AS until FROM flags GROUP BY ALL),
r AS (SELECT 'views' AS src_table, 'at_id' AS ref_field, v.k, v.us, p.since, p.until FROM (SELECT {_text("at_id")} AS k, {_US} AS us FROM views) v LEFT JOIN p1 p ON p.k = v.k
UNION ALL SELECT 'syncs', 'vdna_user_id', s.k, s.us, p.since, p.until FROM (SELECT {_user("vdna_user_id")} AS k, {_US} AS us FROM syncs) s LEFT JOIN p2 p ON p.k = s.k),
o AS (SELECT *, {_DAY} AS day_utc, CASE WHEN since IS NULL THEN 'missing' WHEN us < since THEN 'late' WHEN us >= until THEN 'deleted' END AS verdict
FROM r WHERE k IS NOT NULL AND us IS NOT NULL)"""

SQL = {
    "p1_sessions": _SESSIONS,
    "p1_found": f"SELECT user_uid, start_ms FROM ({_SESSIONS})",
    "p2_rolling": _ROLLING,
    "p2_found": f"SELECT user_uid, day_utc FROM ({_ROLLING}) WHERE n_records = 0 AND total_30d >= 20 AND total_7d * 10 >= total_30d * 7",
    "p5_features": f"""WITH p AS ({_PAIRS}), f AS (SELECT uid, count(*) AS n_types,
string_agg(kind || ':' || timed || ':' || total || ':' || coalesce(CAST(last AS VARCHAR), '-'), ';' ORDER BY kind) AS features FROM p GROUP BY uid),
n AS (SELECT uid, count(*) AS n_records FROM ({RECORDS}) GROUP BY uid)
SELECT n.uid AS user_uid, n_records, coalesce(n_types, 0) AS n_types, coalesce(features, '') AS features FROM n LEFT JOIN f USING (uid)""",
    "p5_found": f"SELECT uid AS user_uid, kind AS event_type FROM ({_PAIRS}) WHERE timed >= 5 AND last < {LAPSED_MS}",
    "p6_per_key": _TOTALS,
    "p6_found": _HEAVY,
    "p7_report": f"{_ORPHANS} SELECT src_table, ref_field, day_utc, verdict, count(*) AS n_refs, count(DISTINCT k) AS n_keys FROM o WHERE verdict IS NOT NULL GROUP BY ALL",
    "p7_found": f"{_ORPHANS} SELECT DISTINCT src_table, ref_field, k AS ref_key, day_utc FROM o WHERE verdict IS NOT NULL",
}
