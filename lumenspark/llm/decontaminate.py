"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the benchmark's items, one scan of each text.

Texts and items are normalised alike: A-Z to a-z, every other ASCII character that is no letter or digit to a space, words
joined by one space.  A window is ``WINDOW`` consecutive words of an item (a shorter item is one window).  Matches start and
end at spaces, so word numbers, and from them offsets in the original text, follow from the spaces before a match.

The automaton takes about 400 bytes of memory for each byte of the benchmark.  A benchmark above ``BLOCK_BYTES`` is dealt by hash
into blocks, each with its automaton; a task holds a bounded part of its texts and scans it block after block, so it never
holds two automata, and the driver never more than the block that it sends.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
#: Bytes of benchmark text in one automaton; bytes of documents that are held while several automata scan them.
BLOCK_BYTES, HELD_BYTES = 1 << 20, 64 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Start and end, in code points of the original text, of each of its words."""
    raw = np.frombuffer(text.encode().translate(_TABLE), np.uint8)
    inside = np.concatenate([[0], (raw != 32).view(np.int8), [0]])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edge = np.diff(inside)
    return list(zip(points[np.flatnonzero(edge == 1)].tolist(), points[np.flatnonzero(edge == -1)].tolist(), strict=True))


class Automaton:
    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW) -> None:
        self.trie = ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        length: dict[str, int] = {}
        for item_id, text in items:
            words = words_of(text)
            for k in range(max(1, len(words) - window + 1) if words else 0):
                part = words[k : k + window]
                key = f" {b' '.join(part).decode('latin-1')} "
                length[key] = len(part)
                owners.setdefault(key, []).append(item_id)
        for key, found in owners.items():
            self.trie.add_word(key, (length[key], tuple(dict.fromkeys(found))))
        self.empty = not owners
        if owners:
            self.trie.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[set[int], set]:
        """Numbers of the hit words, ids of the items whose windows occur."""
        hit: set[int] = set()
        items: set = set()
        if self.empty or not words:
            return hit, items
        text = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.trie.iter(text))
        if found:
            before = np.cumsum(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
            for end, (n, owners) in found:
                last = int(before[end]) - 1  # the space at ``end`` closes word number (spaces up to it) - 2, counted from 0
                hit.update(range(last - n, last))
                items.update(owners)
        return hit, items


def _blocks(benchmark: DataFrame) -> list:
    """Broadcasts of the items, in blocks of about ``BLOCK_BYTES`` or one item; the driver holds one block at a time."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [context.broadcast([(row.item_id, row.text) for row in items.filter(place == k).collect()]) for k in range(n)]


def _spans(text: str | None, hit: list[int]) -> list[list[int]]:
    """Start and end, in code points of the original text, of each run of hit words."""
    if not hit:
        return []
    at, out, last = word_offsets(text or ""), [], -2
    for word in hit:
        if word == last + 1:
            out[-1][1] = at[word][1]
        else:
            out.append(list(at[word]))
        last = word
    return out


_automata: dict[str, Automaton] = {}
_STATE = "n_words int, hit int, items array<long>, spans array<array<int>>"


def _held(batches, n: int):
    """Slices of the batches, together up to ``HELD_BYTES`` where several automata scan them."""
    held, size = [], 0
    for batch in common.text_slices(batches, 8 << 20):
        held.append(batch)
        size += batch.nbytes
        if n == 1 or size > HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _name(i: int, column: str) -> str:
    return "text" if column == "text" else f"__c{i}"


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The columns of ``docs``, renamed by ``_name``, and the state of each row."""
    named = docs.select(*[docs[c].alias(_name(i, c)) for i, c in enumerate(docs.columns)])
    carried = named.columns
    blocks = _blocks(benchmark)
    name = uuid.uuid4().hex

    def automaton(k):
        if f"{name}{k}" not in _automata:
            _automata.clear()
            _automata[f"{name}{k}"] = Automaton(blocks[k].value, window)
        return _automata[f"{name}{k}"]

    def scan(batches):
        for held in _held(batches, len(blocks)):
            words = [[words_of(t) for t in batch.column("text").to_pylist()] for batch in held] if len(blocks) == 1 else None
            hits = [[(set(), set()) for _ in range(batch.num_rows)] for batch in held]
            sizes = [[0] * batch.num_rows for batch in held]
            for k in range(len(blocks)):
                known = automaton(k)
                for b, batch in enumerate(held):
                    for i, t in enumerate(words[b] if words else map(words_of, batch.column("text").to_pylist())):
                        sizes[b][i] = len(t)
                        hit, items = known.scan(t)
                        hits[b][i][0].update(hit)
                        hits[b][i][1].update(items)
            for batch, found, n in zip(held, hits, sizes, strict=True):
                runs = [_spans(batch.column("text")[i].as_py(), sorted(hit)) if hit else [] for i, (hit, _) in enumerate(found)]
                state = [pa.array(n, pa.int32()), pa.array([len(hit) for hit, _ in found], pa.int32()), pa.array([list(x) for _, x in found], pa.list_(pa.int64())), pa.array(runs, pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *state], names=[*carried, "n_words", "hit", "items", "spans"])

    schema = T.StructType([*named.schema.fields, *T._parse_datatype_string(_STATE).fields])
    return named.mapInArrow(scan, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (runs of hit words: start:end in code
    points of the original text, comma-joined); columns of ``docs`` of these names are replaced.

    A null or empty text, or one of separators only, has no words and is clean; an item without words has no window; a null
    item_id counts as an item but is left out of the digest; equal items both count; repeated rows stay; an empty table gives no
    rows, an empty benchmark leaves every document clean.
    """
    own = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"]
    ids = F.array_sort(F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: x.cast("string")))
    spans = F.transform("spans", lambda x: F.concat_ws(":", x[0].cast("string"), x[1].cast("string")))
    return _scanned(docs, benchmark, window).select(
        *[F.col(_name(i, c)).alias(c) for i, c in enumerate(docs.columns) if c not in own],
        F.col("n_words").cast("long").alias("n_words"),
        F.col("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        common.digest(F.concat_ws(",", ids)).alias("items_sha256"),
        (F.col("hit") > 0).alias("contaminated"),
        F.concat_ws(",", spans).alias("hit_spans"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with its columns alone, in which no window of the benchmark occurs (null texts among them)."""
    return _scanned(docs, benchmark, window).filter("hit = 0").select(*[F.col(_name(i, c)).alias(c) for i, c in enumerate(docs.columns)])
