"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from sievemill.plans.oracles import ORACLES
from sievemill.plans.queries import QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    def cell(v):
        return "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        assert rows(got) == rows(con.execute(ORACLES[name]).df())


def test_cut_references_are_text(spark, tmp_path):
    """A reference that a cut has robbed of its end, and names that are not listed: as in the SQL."""
    cut = ["a&amp", "a&am", "a&", "&amp;&amp", "&amp;lt;", "&amp;amp", "&quot", "&lt b", "&copy x", "&#39;", "&#38", "&eacute;", "&notit;", "&&amp;&", None]
    html = [t and f"<html><head><title>{t}</title></head><body><nav>&amp</nav><article class='&amp'>{t}</article></body></html>" for t in cut]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").selectExpr("page_id", "'https://h/' || page_id AS url", "html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    name = "html_content_parser"
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(c.execute(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
