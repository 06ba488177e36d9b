import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from conftest import CHECKED
from logmill.llm import registry


def test_one_query_for_each_operator_and_the_pipeline():
    names = [name.split("_")[0] for name in registry.queries()]
    assert names == [f"op{n}" for n in range(1, 14)]
    assert set(registry.queries()) | {"pipeline"} <= set(entry.queries())
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()


def test_sql_is_for_queries_and_runs():
    database = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{CHECKED}/{table}.parquet'")
    for name, statement in registry.oracle_sql().items():
        assert name in registry.queries()
        assert database.execute(f"SELECT count(*) FROM ({statement})").fetchone()[0] > 0


def test_contract_columns(spark):
    want = {
        "op1": "doc_id:bigint held_out:boolean lang_pred:string score:double",
        "op3": "page_id:bigint host:string path:string rule:string verdict:string",
        "op4": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
        "op5": "page_id:bigint payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
        "op6": "query_id:bigint rank:int vec_id:bigint score:bigint",
        "op7": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
        "op8": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
        "op9": "doc_id:bigint fingerprint:string component_id:bigint",
        "op10": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
        "op11": "doc_id:bigint leaf:string subroot:string root:string proof_sha256:string folded_root:string verified:boolean",
        "op12": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
        "op13": "conv_id:bigint depth:bigint parent_conv_id:bigint n_convs:bigint n_children:bigint n_leaves:bigint saved_tokens:bigint ends_sha256:string",
    }
    small = CHECKED.replace("sf0.01", "sf0.001")
    for name, query in registry.queries().items():
        if columns := want.get(name.split("_")[0]):
            found = {f"{c}:{kind}" for c, kind in query(spark, small).dtypes}
            assert set(columns.split()) <= found, name
