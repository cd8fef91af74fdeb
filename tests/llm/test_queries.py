"""Every registered query of the subpackage, with its production parameters, over the smallest tables."""

import pytest

from genomark.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "class_id", "n_links"},
    "op2": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op3": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op4": {"page_id", "host", "path", "rule", "verdict"},
    "op5": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op6": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op8": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op9": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op10": {"doc_id", "n_tokens", "rate", "copies"},
    "op11": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
    "op12": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
}
KEYS = {"op4": ("pages", "page_id"), "op11": ("conversations", "conv_id")}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    table, key = KEYS.get(name.split("_")[0], ("documents", "doc_id"))
    out = queries.queries()[name](spark, DATA).cache()
    given = sorted(r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())
    got = sorted(r[0] for r in out.select(key).collect())
    given = sorted(set(given)) if name.startswith("op11") else given
    assert set(out.columns) >= COLUMNS[name.split("_")[0]] and (sorted(set(got)) == sorted(set(given)) if name.startswith("op2") else got == given)
    if name.startswith("op7"):
        near, other = out.agg({"near_edited": "avg", "near_next": "avg"}).first()
        assert max(near, other) > 0.5 and min(near, other) < 0.2
