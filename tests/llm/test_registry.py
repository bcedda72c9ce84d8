"""The queries' columns, and the SQL of those that have it."""
import duckdb
import pytest

from sigspark.llm.registry import ORACLE, QUERIES

COLUMNS = {"op1_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op3_quality": ["doc_id", "held_out", "score", "predicted"], "op4_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
           "op6_language": ["doc_id", "held_out", "lang_pred", "score"], "op7_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"], "op9_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
           "op10_toxicity": ["doc_id", "held_out", "score", "predicted"]}


OTHERS = {"op11_collocations", "op12_warc", "op13_whitening"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHERS))
def test_one_row_per_document(spark, sf, name):
    out = QUERIES[name](spark, sf)
    assert set(COLUMNS.get(name, ["doc_id"])) <= set(out.columns)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLE[name]).df()
    order = sorted(want.columns)
    got = QUERIES[name](spark, sf).select(*order).toPandas()
    assert sorted(map(tuple, got.astype(str).values.tolist())) == sorted(map(tuple, want[order].astype(str).values.tolist()))
