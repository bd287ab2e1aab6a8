"""Queries with equal SQL, and the shape of all others."""

import pytest

from playmetry.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_nearest_neighbours": "query_id rank vec_id score",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op3_mixing_sources": "doc_id size source_size target taken",
    "op4_sentencepiece": "doc_id n_pieces lossless",
    "op5_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op6_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op7_html_extraction": "page_id url text n_chars",
    "op8_url_filters": "page_id host path rule verdict",
    "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op12_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op13_lexical_search": "item_id rank doc_id score",
}


def rows(arrow):
    names = sorted(arrow.column_names)
    return names, sorted(zip(*[arrow[n].to_pylist() for n in names]), key=str)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(name, llm, duck, sf):
    got = QUERIES[name](llm, sf).toArrow()
    assert set(COLUMNS[name].split()) <= set(got.column_names)
    assert got.num_rows
    if name in ORACLES:
        assert rows(got) == rows(duck.execute(ORACLES[name]).to_arrow_table())
    else:
        assert rows(got) == rows(QUERIES[name](llm, sf).toArrow())  # reruns agree


def test_all_listed():
    assert set(QUERIES) == set(COLUMNS)
