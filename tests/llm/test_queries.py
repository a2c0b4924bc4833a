"""The registered queries: names, columns of the contracts, no names the SQL can't have."""

import __spark_entry__ as entry

COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op4": "doc_id size source_size target taken",
    "op5": "vec_id n_links component_id kept", "op6": "doc_id held_out score predicted", "op7": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8": "doc_id fingerprint component_id", "op9": "doc_id start n_tokens ids_crc32", "op10": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256", "op12": "doc_id n_words n_removed kept_sha256",
    "op13": "word form root n n_near form_n",
}


def test_each_operator_has_one_query():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_queries_return_the_columns_of_their_contracts(spark):
    for name, query in entry.queries().items():
        if (n := name.split("_")[0]) in COLUMNS:
            found = query(spark, "/root/testdata/sf0.001")
            assert set(COLUMNS[n].split()) <= set(found.columns), name
