"""Queries with SQL against DuckDB on the smallest tables; shape of all of them."""

from pathlib import Path

import duckdb
import pytest

from lotgrid.llm.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
COLUMNS = {
    "op1": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op2": {"doc_id", "held_out", "score", "predicted"}, "op3": {"page_id", "url", "text", "n_chars"}, "op4": {"doc_id", "n_shingles", "component_id", "kept"},
    "op5": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op6": {"doc_id", "held_out", "lang_pred", "score"},
    "op7": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op8": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op9": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op10": {"doc_id", "size", "source_size", "target", "taken"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table_comes_back(spark, name):
    out = QUERIES[name](spark, str(DATA)).toPandas()
    op = name.split("_")[0]
    assert COLUMNS[op] <= set(out.columns)
    table, key = ("pages", "page_id") if op == "op3" else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
    assert set(out[key]) == ids and (op == "op7" or len(out) == len(ids))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got, cursor = QUERIES[name](spark, str(DATA)), duck.execute(ORACLE[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, got.select(*columns).toPandas().values.tolist())) == sorted(repr(list(r)) for r in cursor.fetchall())
