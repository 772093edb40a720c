"""The registered queries at the smallest scale, against their SQL where there is one."""

import pytest
from conftest import SMALL, same_rows

from cadenza.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE_SQL:
        same_rows(df, ORACLE_SQL[name], SMALL)
    else:
        table = {"op5_urls": "pages", "op7_warc": "pages", "op12_clusters": "embeddings"}.get(name, "documents")
        assert df.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
