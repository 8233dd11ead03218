import pytest

duckdb = pytest.importorskip("duckdb")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["corpus_stats", "parse_pages", "chunk_windows", "vector_topk", "kg_edges", "entity_pool", "relation_pool", "type_vote", "drop_reasons", "merge_seeds", "evidence_prompt", "provenance_chunks", "batches", "batch_lists", "embed_hash", "entities_sorted", "relations_sorted", "kg_edges_evidence", "kg_load", "kg_stats", "fact_endpoints", "profile_validate", "batch_validate", "batch_validate_v3", "batch_validate_v2", "secondary_seeds", "compare_channels", "batch_entities", "batch_records", "chunk_layout", "chunk_texts", "chunks_per_paper", "expected_batches", "profile_heads", "corpus_counts", "lexical_seeds", "lexical_seeds_v1", "questions_facts", "questions_seeds", "questions_provenance", "adjacent_facts", "canonical_document", "graph_upkeep", "index_upkeep", "page_text_files", "page_files_scan", "chunk_lines", "model_answers", "model_records", "ingest_journal", "experiment_records", "table_upkeep", "table_states", "paper_ids", "name_forms", "canonical_names", "rewritten_questions", "valid_texts", "introduces_from_profiles", "profile_files"]


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, small, con, name):
    from lodestone.plans import registry

    got = registry.queries()[name](spark, small).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_entry(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
