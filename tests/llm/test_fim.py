"""Fill-in-the-middle: the automaton and the operator against plain string work."""

import random

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from lumenspark.llm import fim, queries

SF = "/root/testdata/sf0.01"
PIECES = ["a", "é", "€", "\U0001f600", "<", "<P", "<S>", "P>", ">", "<M", "<<", " ", "\n", "word", "ß" * 70, "x" * 300, "\U0001f1e9" * 90]


def texts(count, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randrange(0, 30))) for _ in range(count)] + ["", "<P>", "x<", "\U0001f600"]


@pytest.mark.parametrize("strip", [1, 7, 256])
def test_counts_and_places(strip, monkeypatch):
    monkeypatch.setattr(fim, "STRIP", strip)
    monkeypatch.setattr(fim, "WINDOW", 64 * strip)
    held = texts(60, 1)
    data = [t.encode() for t in held]
    scan = fim.Scan(fim.ByteDfa(fim.SENTINELS), data)
    assert np.diff(scan.first).tolist() == [len(t) for t in held]
    places = [(int(a) + len(t[:k].encode()), int(f) + k) for t, a, f in zip(held, scan.begin, scan.first, strict=False) for k in range(len(t))]
    assert scan.unit_places(np.array([k for _, k in places])).tolist() == [p for p, _ in places]
    ends = [int(a) + len(t[: i + 3].encode()) for t, a in zip(held, scan.begin, strict=False) for i in range(len(t)) if t[i : i + 3] in fim.SENTINELS]
    assert scan.sentinel_ends().tolist() == ends


def test_table_and_bad_sentinels():
    dfa = fim.ByteDfa(["<fim_pre>", "<fim_suf>", "<fim_mid>"])
    assert fim.Scan(dfa, [b"<fim_<fim_pre>x", b"<fim_suf><fim_mi"]).sentinel_ends().tolist() == [14, 25]
    # bytes that are no UTF-8 are a unit each
    assert np.diff(fim.Scan(dfa, [b"\x80\x80a", "é".encode()[:1], b"\xf0\x9f\x98\x80\x80"]).first).tolist() == [3, 1, 2]
    for bad in (["<a>", "<a>b"], ["ab", "ba"], ["", "x"], ["aba", "c"], ["é", "x"], ["abc", "b"]):
        with pytest.raises(ValueError, match="sentinel"):
            fim.ByteDfa(bad)


def test_operator_on_edges(spark):
    rows = list(enumerate(texts(300, 2))) + [(None, None), (None, "null key"), (5, None), (7, "tie"), (7, "tie"), (900, "long é " * 40_000)]
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, form string, n int, restored string").repartition(3)
    found = fim.restore(fim.transform(docs))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, brute.sha(r.output), brute.sha(r.restored)) for r in found.collect()), key=repr) == sorted(((d, *brute.fill_in_middle(d, t)) for d, t in rows), key=repr)
    assert {r.form for r in found.select("form").collect()} == {"plain", "psm", "spm"}
    assert fim.transform(docs.filter("false")).count() == 0
    with pytest.raises(Exception, match="three sentinels"):
        fim.restore(spark.createDataFrame([("psm", "<P>a<S>b")], "form string, output string")).collect()


def test_rates(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    forms = lambda **k: [r.form for r in fim.transform(docs, **k).select("form").collect()]
    assert set(forms(rate=0)) == {"plain"} and set(forms(rate=100, spm_rate=100)) == {"spm"} and set(forms(rate=100, spm_rate=0)) == {"psm"}


def test_query(spark):
    documents = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    found = queries.op11_fill_in_middle(spark, SF)
    assert sorted(map(tuple, found.collect())) == sorted((d["doc_id"], *brute.fill_in_middle(d["doc_id"], d["text"])) for d in documents)
