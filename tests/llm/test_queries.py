"""The registered queries: names, columns, and their SQL where there is one."""

from pathlib import Path

import duckdb
import pytest

from webloom.llm import queries

COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"], "op3": ["page_id", "url", "text", "n_chars"], "op4": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op5": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op6": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op9": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op10": ["doc_id", "n_shingles", "component_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_rows_of_the_whole_table(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    wanted = COLUMNS.get(name.split("_")[0], [])
    assert df.columns[: len(wanted)] == wanted
    if "doc_id" in df.columns and not name.startswith("op8"):
        assert {r[0] for r in df.select("doc_id").distinct().collect()} == {r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    expected = con.sql(queries.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(expected, key=repr)
