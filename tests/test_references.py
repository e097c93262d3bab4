"""Character references with and without their semicolon, as in titles that were cut within one."""

import duckdb
import pytest

from webloom.functions import html
from webloom.plans import registry

CUT = ["R&amp;D &amp;&amp", "a&am", "a&a", "x&quo", "&quot;x&quot", "1 &lt; 2 &lt", "&ampfoo;", "&notit; &copy", "&amp;lt;", "a & b &; && &#"]
CUT += ["w" * 160 + "&amp"]  # three of these and a word have over 500 characters as written, and under 500 decoded


@pytest.mark.parametrize("name", ["t11_titles", "t15_t16_readable", "t17_acceptance"])
def test_cut_references_as_in_the_sql(spark, tmp_path, name):
    pages = [(i, f"https://a.example/{i}", f"<html><head><title>{x}</title></head><body><h1>{x}</h1><p>text &amp; {x}</p></body></html>") for i, x in enumerate(CUT)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_pages_are_read_as_browsers_do():
    """The operator decodes old names without a semicolon; closed references are decoded either way."""
    root = lambda h: html.title(html.parse(f"<title>{h}</title>"))
    assert [root(x) for x in ("R&ampD", "&copy 1", "&am")] == ["R&D", "\xa9 1", "&am"]
    assert [root(html.closed_references(x)) for x in ("R&ampD", "&copy 1", "&am", "&eacute;&#233;&#xE9;", "&#233")] == ["R&ampD", "&copy 1", "&am", "\xe9\xe9\xe9", "&#233"]
