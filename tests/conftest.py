import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from cadenza.ship import ship

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", "/tmp/cadenza-warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return ship(session)


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_dir():
    return SMALL


def same_rows(df, sql, sf_dir):
    """Compare a DataFrame with DuckDB SQL over the Parquet tables of a folder."""
    import duckdb

    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM parquet_scan('{path}')")
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)

    def norm(v):
        return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)

    want = sorted(tuple(norm(v) for _, v in sorted(zip(names, row, strict=True))) for row in cursor.fetchall())
    got = sorted(tuple(norm(v) for _, v in sorted(r.asDict().items())) for r in df.collect())
    assert got == want
