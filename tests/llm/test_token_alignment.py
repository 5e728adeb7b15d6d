"""Cross-tokenizer alignment: cuts, groups and corpus-wide counts against whole texts encoded one by one."""

import random

import brute
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenspark.llm import queries, token_alignment

SF = "/root/testdata/sf0.01"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["the", " the", "  ", " ", "\n", "\n\n", "\t", "\r\n", " ", " ", " ", "\x1c", "\x00", "é", "é", "日本語", "\U0001f600", "<s>", "</s>", "<|endoftext|>", "<0x41>", "'s", " 's", "12345", "...", ");\r", "Ġ", "abab", "x" * 30, " - "]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def pair():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        return token_alignment.Pair(f.read(), g.read())


def mixed(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(1, 25))) for _ in range(n)]


def test_segments_have_the_tokens_of_their_texts(pair):
    assert pair.separable
    for text in mixed(400, 1):
        segments = pair.cut(text)
        assert "".join(" " + s for s in segments) == " " + text
        a, _, b, _, _, _, same = pair.aligned(segments)
        assert a.tolist() == pair.a.encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == pair.b.encode(text) and same.all()
    assert not pair.aligned(["a▁b"])[-1].any()


@pytest.mark.parametrize("limits", [{"WIDE": 2, "_LONG": 400}, {"WIDE": 0, "STEP": 3}, {"STEP": 1, "JOINED": 4}])
def test_limits_change_nothing(pair, limits, monkeypatch):
    segments = sorted({s for text in [*mixed(60, 3), "ab" * 300] for s in pair.cut(text)})

    def held():
        packed = token_alignment._packed(*pair.aligned(segments)[:-1])
        block = token_alignment.Block(*token_alignment._unpacked(*token_alignment._values(packed, np.uint16)), len(pair.b_bytes))
        for k in range(0, len(segments), 7):
            block.count(np.arange(k, min(len(segments), k + 9)))
        block.value(block.pairs, block.seen + 1, block.seen % 2)
        return [block.pairs.tolist(), block.seen.tolist(), block.count_sum.tolist(), block.n_best.tolist(), block.n_links.tolist(), block.written().to_pylist()]

    expected = held()
    for k, v in limits.items():
        monkeypatch.setattr(token_alignment, k, v)
    assert held() == expected


@pytest.mark.parametrize("block", [token_alignment.BLOCK, 40])
def test_edges(spark, block):
    texts = [*mixed(150, 2), None, "", " ", "  ", " a", "a ", "a▁b ▁", "▁", "tie", "tie", "ab" * 3000, "\U0001f1e9" * 400, "word " * 20_000]
    rows = [(None if i == 3 else i if i != 20 else 19, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, 1, "s", True) for d, t in rows], "doc_id long, text string, block int, segment string, same boolean").repartition(4)
    found = token_alignment.align(docs, A, B, groups=True, block=block)
    assert sorted(map(tuple, found.select(*COLUMNS).collect()), key=repr) == sorted(brute.token_alignment(rows), key=repr)
    assert found.filter(F.col("groups_sha256") != F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).count() == 0


def test_pairs_and_empty(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the the"), (3, "the cat"), (4, None)], "doc_id long, text string")
    pairs = token_alignment.Alignment(docs, A, B).pairs.collect()
    assert {r.n for r in pairs} == {2, 3} and all(r.best for r in pairs)
    assert token_alignment.align(docs.filter("false"), A, B).count() == 0
    assert [tuple(r)[1:] for r in token_alignment.align(docs.filter("doc_id = 4"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_no_cuts_where_tokens_reach_across():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        a, b = f.read().replace('"add_prefix_space":false', '"add_prefix_space":true', 1).replace('"add_prefix_space": false', '"add_prefix_space": true', 1), g.read()
    pair = token_alignment.Pair(a, b)
    assert not pair.separable and pair.cut("one two") == ["one two"]


def test_query(spark):
    documents = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert sorted(map(tuple, queries.op13_token_alignment(spark, SF).select(*COLUMNS).collect())) == sorted(brute.token_alignment([(d["doc_id"], d["text"]) for d in documents]))
