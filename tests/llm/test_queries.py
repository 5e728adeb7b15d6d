"""Every query on the whole small tables against its brute-force version."""

import brute
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from lumenspark.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


def rows(spark, name, *columns):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).select(*columns).collect())


def test_op1(spark, documents):
    expected = sorted((d["doc_id"], *brute.secrets(d["text"])) for d in documents)
    assert rows(spark, "op1_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == expected


def test_op2(spark, documents):
    expected = sorted(brute.components([(d["doc_id"], d["text"]) for d in documents]))
    assert rows(spark, "op2_ngram_jaccard_join", "doc_id", "n_shingles", "component_id") == expected


def test_op3(spark, documents):
    pairs = [(d["doc_id"], d["text"]) for d in documents]
    expected = sorted((*a, b) for a, b in zip(brute.repeated(pairs), brute.passage_words(pairs), strict=True))
    assert rows(spark, "op3_substring_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words") == expected


def test_op4(spark, documents):
    encoding = brute.tiktoken_encoding()
    expected = sorted((d["doc_id"], *brute.bpe(d["text"], encoding)) for d in documents)
    assert rows(spark, "op4_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_op5(spark, documents):
    found = queries.op5_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(d["doc_id"] for d in documents)
    import zlib

    text = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    assert all(r["size"] == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in found)
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    source = dict(pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "source"]).to_pandas().itertuples(index=False))
    for name in set(source.values()):
        share = [sum(source[r.doc_id] == name for r in found if r.shard == k) for k in range(40)]
        assert max(share) - min(share) <= 2


def test_op7(spark):
    pages = pq.read_table(f"{SF}/pages.parquet", columns=["page_id", "url"]).to_pylist()
    key = lambda r: (r[0], r[1], r[2], r[3] or "", r[4])
    expected = sorted(((p["page_id"], *brute.url_verdict(p["url"], queries.URL_RULES)) for p in pages), key=key)
    assert sorted((tuple(r) for r in queries.op7_url_filter(spark, SF).collect()), key=key) == expected


def test_op8(spark, documents):
    from tokenizers import Tokenizer

    ordered = sorted((d["doc_id"], d["text"]) for d in documents)
    expected = brute.token_files(ordered, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert rows(spark, "op8_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == expected


def test_op9(spark, documents):
    items = [(i["item_id"], i["text"]) for i in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    expected = sorted((d["doc_id"], *brute.contamination(d["text"], items)) for d in documents)
    assert rows(spark, "op9_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected


def test_op10(spark, documents):
    expected = sorted((d["doc_id"], *brute.quality_counts(d["text"])) for d in documents)
    found = queries.op10_quality_rules(spark, SF).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == expected
    source = dict(pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "source"]).to_pandas().itertuples(index=False))
    assert sorted((r.doc_id, r.kept, r.host_verdict) for r in found) == sorted(brute.quality_verdicts([(d["doc_id"], d["text"], source[d["doc_id"]]) for d in documents]))
    assert not any(r.kept and (r.base_failed or r.rules_failed) for r in found) and 0 < sum(r.kept for r in found) < len(found)
