"""Queries of the llm problems, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import reading
from tidemark.llm import contamination, distinct, frequent, mixing, residue
from tidemark.sources.tables import table

GROUPS = ("day_utc", "country_code", "api_key")
FREQUENT = (("views", "url"), ("event_log", "user_agent"))
SHARE = 0.005
LEAST_WORDS = 13


def _country(column: str):
    code = F.upper(F.trim(column))
    return F.when(code != "", code)


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    groups = {"day_utc": reading.day_text(reading.instant_us(F.col("timestamp"))), "country_code": _country("country_code"), "api_key": reading.text_key(F.col("api_key"))}
    return distinct.pattern_totals(distinct.membership(table(spark, d, "event_log"), reading.user_id(F.col("user_uid")), groups))


def p3_distinct_cube(spark: SparkSession, d: str) -> DataFrame:
    return distinct.distinct_cube(_patterns(spark, d), GROUPS)


def p3_returning(spark: SparkSession, d: str) -> DataFrame:
    """Users seen in the first week and in the last week but never in GB."""
    week = lambda a, b: lambda cell: cell["day_utc"].between(a, b)
    both = [week("2014-10-01", "2014-10-07"), week("2014-11-24", "2014-11-30")]
    return distinct.count_matching(_patterns(spark, d), all_of=both, none_of=[lambda cell: cell["country_code"] == "GB"])


def p3_sketched(spark: SparkSession, d: str) -> DataFrame:
    """Per level how many groups sketches give, and whether at least 95 % of them lie within the bound of the exact counts."""
    rows, user = table(spark, d, "event_log"), reading.user_id(F.col("user_uid"))
    groups = {"day_utc": reading.day_text(reading.instant_us(F.col("timestamp"))), "country_code": _country("country_code")}
    exact = distinct.distinct_cube(distinct.pattern_totals(distinct.membership(rows, user, groups)), list(groups))
    estimated = distinct.estimated_cube(distinct.cell_sketches(rows, user, groups))
    same = [exact[n].eqNullSafe(estimated[n]) for n in ("level", *groups)]
    within = F.abs(exact["n_distinct"] - estimated["n_distinct"]) <= estimated["error_bound"]
    both = exact.join(estimated, same).select(exact["level"].alias("level"), within.alias("within"))
    return both.groupBy("level").agg(F.count(F.lit(1)).alias("n_groups"), (F.count_if("within") >= 0.95 * F.count(F.lit(1))).alias("within_bound"))


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, field in FREQUENT:
        found = frequent.frequent_values(table(spark, d, name), F.col(field), SHARE)
        parts.append(found.withColumns({"src_table": F.lit(name), "field_name": F.lit(field)}))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d).select("src_table", "field_name", "item")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """The frequent values with exact counts, and whether the sketch's bounds enclose them."""
    within = F.col("n_rows").between(F.col("lower_bound"), F.col("upper_bound"))
    return _frequent(spark, d).select("src_table", "field_name", "item", "n_rows", within.alias("within_bounds"))


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    return contamination.contaminated(table(spark, d, "documents"), table(spark, d, "eval_items"), LEAST_WORDS)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("doc_id", "item_id").distinct()


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked_items(table(spark, d, "eval_items"), _tiles(spark, d))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_report(spark, d).where("runs_dry").select("source")


def p9_characters(spark: SparkSession, d: str) -> DataFrame:
    """The report with sizes in characters, but for the shares of sources that do not run dry, which depend on the shuffle."""
    sized = mixing.sized_documents(table(spark, d, "documents"), size=F.length("text"))
    report = mixing.mixture_report(sized, table(spark, d, "mix_targets"))
    return report.select("source", "target_share", "max_repeats", "size", "available", "runs_dry", F.when(F.col("runs_dry"), F.col("actual_tokens")).alias("given_if_dry"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p10_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_residue(spark, d).select("doc_id")


QUERIES = {f.__name__: f for f in (p3_distinct_cube, p3_returning, p3_sketched, p4_found, p4_counts, p8_found, p8_leaked_items, p9_found, p9_report, p9_characters, p9_mixture, p10_found, p10_residue)}


def _user(column: str) -> str:
    canonical = "lower(" + " || '-' || ".join(f"substr(trim({column}), {a}, {n})" for a, n in ((1, 8), (10, 4), (15, 4), (20, 4), (25, 12))) + ")"
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return f"CASE WHEN length(trim({column})) = 36 AND regexp_matches({canonical}, '{shape}') AND {canonical} <> '{reading.NIL_UUID}' THEN {canonical} END"


_CELLS = f"""SELECT DISTINCT {_user("user_uid")} AS uid, strftime(make_timestamp(nullif(epoch_us("timestamp"), 0)), '%Y-%m-%d') AS day_utc,
nullif(upper(trim(country_code)), '') AS country_code, nullif(trim(api_key, ' ' || chr(13)), '') AS api_key FROM event_log WHERE {_user("user_uid")} IS NOT NULL"""


def _cube_sql() -> str:
    parts = []
    for level in range(8):
        used = [g for i, g in enumerate(GROUPS) if level >> 2 - i & 1]
        fields = ", ".join(g if g in used else f"CAST(NULL AS VARCHAR) AS {g}" for g in GROUPS)
        known = " AND ".join(f"{g} IS NOT NULL" for g in used) or "true"
        grouped = f"GROUP BY {', '.join(used)}" if used else ""
        parts.append(f"SELECT {level} AS level, {fields}, count(DISTINCT uid) AS n_distinct, 0 AS error_bound FROM c WHERE {known} {grouped}")
    return f"WITH c AS ({_CELLS}) " + " UNION ALL ".join(parts)


def _sketched_sql() -> str:
    parts = []
    for level, used in enumerate(((), ("country_code",), ("day_utc",), ("day_utc", "country_code"))):
        known = " AND ".join(f"{g} IS NOT NULL" for g in used) or "true"
        fields = ", ".join(used) or "1"
        parts.append(f"SELECT {level} AS level, count(*) AS n_groups, true AS within_bound FROM (SELECT DISTINCT {fields} FROM c WHERE {known}) HAVING count(*) > 0")
    return f"WITH c AS ({_CELLS}) " + " UNION ALL ".join(parts)


_HAS_VALUE = "trim({f}, ' ' || chr(9) || chr(10) || chr(13)) <> ''"


def _frequent_sql(fields: str) -> str:
    parts = []
    for name, field in FREQUENT:
        has = _HAS_VALUE.format(f=field)
        parts.append(
            f"SELECT '{name}' AS src_table, '{field}' AS field_name, {field} AS item{fields} FROM {name} WHERE {has} GROUP BY {field} "
            f"HAVING count(*) >= {SHARE} * (SELECT count(*) FROM {name} WHERE {has})"
        )
    return " UNION ALL ".join(parts)


def _runs_sql(table_name: str, key: str) -> str:
    words = f"SELECT {key} AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {table_name}"
    return f"""SELECT DISTINCT id, array_to_string(w[i : i + {LEAST_WORDS - 1}], ' ') AS run
FROM (SELECT id, w, unnest(range(1, len(w) - {LEAST_WORDS - 2})) AS i FROM ({words}) WHERE len(w) >= {LEAST_WORDS})"""


_FOUND8 = f"SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM ({_runs_sql('documents', 'doc_id')}) a JOIN ({_runs_sql('eval_items', 'item_id')}) b ON a.run = b.run"

SQL = {
    "p3_distinct_cube": _cube_sql(),
    "p3_sketched": _sketched_sql(),
    "p3_returning": f"""WITH c AS ({_CELLS}) SELECT count(*) AS n_distinct FROM (SELECT uid FROM c GROUP BY uid
HAVING bool_or(day_utc BETWEEN '2014-10-01' AND '2014-10-07') AND bool_or(day_utc BETWEEN '2014-11-24' AND '2014-11-30') AND NOT coalesce(bool_or(country_code = 'GB'), false))""",
    "p4_found": _frequent_sql(""),
    "p4_counts": _frequent_sql(", count(*) AS n_rows, true AS within_bounds"),
    "p8_found": _FOUND8,
    "p9_characters": """WITH s AS (SELECT nullif(lower(trim(source)), '') AS source, length(text) AS n FROM documents),
t AS (SELECT nullif(lower(trim(source)), '') AS source, sum(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY ALL),
r AS (SELECT t.*, CAST(coalesce((SELECT sum(n) FROM s WHERE s.source = t.source), 0) AS BIGINT) AS size, (SELECT sum(n) FROM s) AS budget FROM t WHERE t.source IS NOT NULL),
f AS (SELECT *, size * max_repeats AS available, size * max_repeats < target_share * coalesce(budget, 0) AS runs_dry FROM r)
SELECT source, target_share, max_repeats, size, available, runs_dry, CASE WHEN runs_dry THEN available END AS given_if_dry FROM f""",
    "p9_found": """WITH s AS (SELECT nullif(lower(trim(source)), '') AS source, length(text) AS n FROM documents),
t AS (SELECT nullif(lower(trim(source)), '') AS source, sum(target_share) AS share, max(max_repeats) AS repeats FROM mix_targets GROUP BY ALL)
SELECT t.source FROM t WHERE t.source IS NOT NULL AND coalesce((SELECT sum(n) FROM s WHERE s.source = t.source), 0) * repeats < share * coalesce((SELECT sum(n) FROM s), 0)""",
}
