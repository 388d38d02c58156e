"""Registered queries of the training-text operators: columns and rows, and SQL where there is some."""

import duckdb
import pytest

import corpus_pipeline
from tests.conftest import DATA, TABLES, table_of
from tracewright.llm.queries import QUERIES, SQL

COLUMNS = {
    "op2_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_decontamination": "doc_id item_id common_words item_words",
    "op6_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op10_mixing": "doc_id size source_size target taken",
    "op11_lexical_search": "item_id rank doc_id score",
    "op12_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    got = table_of(df.columns, df.collect())
    cursor = con.execute(SQL[name])
    assert got == table_of([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(SQL)))
def test_columns(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS[name].split()
    assert df.count() > 0
