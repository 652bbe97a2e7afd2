"""Every query of the catalogue against DuckDB, on the smallest tables."""

import duckdb
import pytest

from quillmere.plans.further import ORACLE, QUERIES
from quillmere.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(values):
    return sorted(([round(v, 9) + 0.0 if isinstance(v, float) else v for v in r] for r in values), key=str)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(df.select(*cols).collect())
    if name in ORACLE:
        result = con.execute(ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == cols
        assert got == rows([r[names.index(c)] for c in cols] for r in result.fetchall())


def test_text_hygiene_has_the_reasons_of_its_sql(spark, tmp_path):
    texts = [None, " ", "no", "no no no ieñga jaez dogarr", "please stop it with tea", "As an AI I like tea, no?", "<@!42> likes green tea", "operations were as requested", "user 123456789012345678 likes tea", "x" * 401]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'a' source", "'en' lang")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.reason for r in QUERIES["text_hygiene"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == dict(c.execute(ORACLE["text_hygiene"]).fetchall())
    assert got[3] is None and got[5] == "question"
