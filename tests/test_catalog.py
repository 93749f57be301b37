"""Every catalog query at the smallest scale, against its SQL in DuckDB where it has one."""

import os

import duckdb
import pytest

from echotrace.plans import catalog, file_catalog, short_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't there")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    run, sql = catalog.QUERIES[name]
    df = run(spark, SF)
    rows = df.collect()
    if not sql:
        assert df.columns
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    found = con.sql(sql)
    names, expected = found.columns, found.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    assert sorted(repr(plain(list(r))) for r in rows) == sorted(repr(plain([r[i] for i in order])) for r in expected)


@pytest.mark.parametrize("langs", [["en"] * 3 + ["de"] * 2, ["en", "de"] * 3, ["en", "de", "en", "fr", "en", "de", "en"], ["de", "en", None, "en", "fr", "en"], ["de"] * 5])
def test_mixed_sources_rounds_as_its_sql(spark, tmp_path, langs):
    """Numbers of documents that four doesn't divide, a language that is missing, and no English at all."""
    rows = list(enumerate(langs))
    spark.createDataFrame(rows, "doc_id long, lang string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    run, sql = catalog.QUERIES["mixed_sources"]
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == sorted(con.sql(sql).fetchall())
