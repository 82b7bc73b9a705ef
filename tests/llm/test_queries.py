"""Every corpus query runs over the smallest tables and returns its contract's columns."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity_scores": {"doc_id", "held_out", "score", "predicted"},
    "op2_compression_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op3_viterbi_tokens": {"doc_id", "tokens"},
    "op4_curriculum_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op5_simhash_groups": {"doc_id", "fingerprint", "component_id"},
    "op6_kd_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op7_latent_leaks": {"doc_id", "item_ids", "share"},
    "op8_quality_scores": {"doc_id", "held_out", "score", "predicted"},
    "op9_suffix_repeats": {"doc_id", "spans", "repeated_words"},
    "op11_embedding_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
    "op12_phrase_automata": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op13_ranked_lexical_search": {"item_id", "rank", "doc_id", "score"},
    "op10_block_top_k": {"query_id", "rank", "vec_id", "score"},
    "pipeline": {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    """Rows, and their agreement with the SQL where there is one, are tested for all registered queries together."""
    assert COLUMNS[name] <= set(entry.queries()[name](spark, SF).columns)


def test_every_corpus_query_is_here_and_four_have_sql():
    corpus = {n for n in entry.queries() if n == "pipeline" or (n.startswith("op") and n[2].isdigit())}
    assert corpus == set(COLUMNS)
    assert {n for n in corpus if n in entry.oracle_sql()} == {"op4_curriculum_mix", "op10_block_top_k", "op12_phrase_automata", "op13_ranked_lexical_search"}
