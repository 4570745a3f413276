"""Every registered query runs; those with an SQL twin agree with it; plans have the shape they should."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
QUERIES = {k: v for k, v in entry.queries().items() if not v.__module__.startswith("tidemark.llm")}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(rows):
    return Counter(tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in row) for row in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, database, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = [tuple(r) for r in frame.select(*columns).collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    twin = database.sql(f"SELECT * FROM ({sql})")
    assert sorted(twin.columns) == columns
    assert canonical(rows) == canonical(database.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [("p1_found", 2), ("p2_found", 2), ("p5_found", 2), ("filter_contains", 0), ("scan_project", 0)])
def test_shuffles(spark, name, most):
    assert exchanges(QUERIES[name](spark, FOLDER)) <= most


def test_workers_import_the_package_from_any_folder(tmp_path):
    """The driver may run elsewhere; the Python workers then know the package only because it is shipped."""
    import os
    import subprocess
    import sys

    repo = Path(__file__).parents[1]
    program = (
        f"import sys; sys.path.insert(0, {str(repo)!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        f"print('ROWS', e.queries()['p1_found'](spark, {FOLDER!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
