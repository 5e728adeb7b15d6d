"""Alignment of two tokenizers over the same bytes, each distinct segment once.

Texts are cut before white space: at a space behind a character that is none.  ``Pair.separable`` verifies from the vocabularies that no
token of either goes on across such a place, so a segment has the same tokens wherever it stands, and a group of the alignment (bytes
between places where tokens of both end) never reaches over it.

1. ``_segmented``: texts are dealt into blocks; a block numbers its distinct segments, a text is a row of these numbers.
2. ``_aligned``: distinct segments of the corpus are tokenised and aligned; the alignments are joined back to the blocks.
3. ``_counted``: how many texts of a block hold each pair of ids linked; the sums by pair are joined back to the blocks.
4. ``_composed``: texts are put together from the alignments of their block.

Blocks bound what a task holds: the alignments of one block's segments.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of text, and distinct segments, after which a block is closed; segments in a row of its list.
BLOCK, BLOCK_SEGMENTS, LISTED = 8 << 20, 1 << 19, 4096
#: Pairs of one group up to which they are written out (above, equal ids of a group are counted first); groups that are written out at once.
WIDE, STEP = 4096, 1 << 16
#: Segments of texts that are put together at once, and segments that are tokenised as one text.
TOGETHER, JOINED = 1 << 19, 1000

_CUT = re.compile(r"(?<=\S)(?= )")
_SOFT = re.compile(r" \s|\s ")
_HEX = re.compile(r"<0x([0-9A-F]{2})>")


def _byte_table() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: the visible ones for themselves, the others from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """A byte-level BPE (A, of the tokenizers library) and a BPE of pieces (B, of the sentencepiece library), with the bytes of each id."""

    def __init__(self, a: str, b: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        table, vocabulary = _byte_table(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(table.__getitem__, token))
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        self.separable = self._separable(json.loads(a))

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(_HEX.fullmatch(piece)[1], 16)])
        return piece.replace("▁", " ").encode()

    def _separable(self, a: dict) -> bool:
        """No token of A or B holds a space behind anything but white space; A splits before white space by the usual byte-level pattern
        and adds no space; B puts exactly one space before a text, and has a token for a space alone."""
        pre = a.get("pre_tokenizer") or {}
        plain = a.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        inner = any(_CUT.search(token.decode("utf-8", "replace")) for token in (*self.a_bytes, *self.b_bytes))
        prefixed = b"".join(self.b_bytes[i] for i in self.b.encode("a")) == b" a" and self.b_bytes[self.blank] == b" "
        return bool(plain and not inner and prefixed)

    def cut(self, text: str) -> list[str]:
        """The segments of a text with a space before it, each without its first space; all of it where the vocabularies don't allow cuts."""
        if not self.separable:
            return [text]
        if text[0] != " " and text[-1] != " " and not _SOFT.search(text):
            return text.split(" ")
        return [s[1:] for s in _CUT.split(" " + text)]

    def _encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and numbers by segment, the same of B, and which segments have their bytes in both; the others have no tokens.

        Segments that end in no white space are tokenised many in a text, which they are cut from by their bytes.
        """
        texts = [s.encode() for s in segments]
        if self.separable and len(segments) > 1 and not any(not s or s[-1].isspace() for s in segments):
            whole = " ".join(segments)
            ids = np.array(self.a.encode(" " + whole, add_special_tokens=False).ids, np.int64), np.array(self.b.encode(whole), np.int64)
            expected = (" " + whole).encode()
            if all(b"".join(map(table.__getitem__, i.tolist())) == expected for i, table in zip(ids, (self.a_bytes, self.b_bytes), strict=True)):
                ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
                numbers = [np.diff(np.searchsorted(np.cumsum(size[i]), ends, side="right"), prepend=0) for i, size in zip(ids, (self.a_size, self.b_size), strict=True)]
                return ids[0], numbers[0], ids[1], numbers[1], np.ones(len(segments), bool)
        a_lists = [e.ids for e in self.a.encode_batch([" " + s for s in segments], add_special_tokens=False)]
        b_lists = [ids if ids or s else [self.blank] for s, ids in zip(segments, self.b.encode(segments, num_threads=1), strict=True)]
        same = np.ones(len(segments), bool)
        for k, text in enumerate(texts):
            same[k] = all(b"".join(map(table.__getitem__, lists[k])) == b" " + text for lists, table in ((a_lists, self.a_bytes), (b_lists, self.b_bytes)))
            if not same[k]:
                a_lists[k] = b_lists[k] = []
        (a, n_a), (b, n_b) = ((np.array([i for ids in lists for i in ids], np.int64), np.array(list(map(len, lists)), np.int64)) for lists in (a_lists, b_lists))
        return a, n_a, b, n_b, same

    def aligned(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """Of segments (each has a space before it): ids of A and numbers by segment, the same of B, tokens of A and B in each group, groups
        by segment, and which segments have the same bytes in both; the others have no tokens."""
        parts = [self._encoded(segments[i : i + JOINED]) for i in range(0, len(segments), JOINED)]
        a, n_a, b, n_b, same = map(np.concatenate, zip(*parts, strict=True))
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        sizes = np.stack([np.bincount(np.searchsorted(ends, e), minlength=len(ends)) for e in (a_ends, b_ends)], axis=1)
        segment_ends = np.concatenate([[0], a_ends])[np.cumsum(n_a)]
        n_groups = np.diff(np.searchsorted(ends, segment_ends, side="right"), prepend=0)
        return a, n_a, b, n_b, sizes, n_groups, same


_pairs: dict[str, Pair] = {}


def _pair(name: str, held) -> Pair:
    if name not in _pairs:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _pairs[name] = Pair(*held.value)
    return _pairs[name]


#: A first number that says: the row goes on in 32 bits.
_LONG = 0xFFFF


def _packed(a, n_a, b, n_b, sizes, n_groups) -> pa.Array:
    """A row for each segment: tokens of A and of B, ids of A, ids of B, tokens of A and B in each group; of 16 bits, and of 32 behind ``_LONG`` where
    a number needs them."""
    numbers = 2 + n_a + n_b + 2 * n_groups
    low = np.cumsum(numbers) - numbers
    out = np.zeros(int(numbers.sum()), np.uint32)
    out[low], out[low + 1] = n_a, n_b
    for values, start, n in ((a, low + 2, n_a), (b, low + 2 + n_a, n_b), (sizes.ravel(), low + 2 + n_a + n_b, 2 * n_groups)):
        out[_ranges(start, n)] = values
    if out.size and out.max() >= _LONG:
        rows = [out[x : x + n] for x, n in zip(low.tolist(), numbers.tolist(), strict=True)]
        return pa.array([(np.concatenate([np.array([_LONG], np.uint16), r.view(np.uint16)]) if r.max() >= _LONG else r.astype(np.uint16)).tobytes() for r in rows], pa.binary())
    offsets = np.concatenate([[0], np.cumsum(2 * numbers)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n_a), [None, pa.py_buffer(offsets), pa.py_buffer(out.astype(np.uint16))])


def _unpacked(values: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """What ``_packed`` was given, with twice the groups' numbers."""
    low = np.cumsum(numbers) - numbers
    if (values[low] == _LONG).any():
        rows = [values[x : x + n] for x, n in zip(low.tolist(), numbers.tolist(), strict=True)]
        rows = [r[1:].copy().view(np.uint32) if r[0] == _LONG else r.astype(np.uint32) for r in rows]
        values, numbers = np.concatenate(rows), np.array(list(map(len, rows)), np.int64)
        low = np.cumsum(numbers) - numbers
    n_a, n_b = values[low].astype(np.int64), values[low + 1].astype(np.int64)
    n_sizes = numbers - 2 - n_a - n_b
    return values[_ranges(low + 2, n_a)], n_a, values[_ranges(low + 2 + n_a, n_b)], n_b, values[_ranges(low + 2 + n_a + n_b, n_sizes)], n_sizes


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, their lowest bytes first, then the next: the higher ones hardly differ, and are packed well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: pa.Scalar) -> np.ndarray:
    held = data.as_buffer()
    return np.frombuffer(held, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64) if held is not None and held.size else np.zeros(0, np.int64)


def _values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows one after another, and their number by row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    low, high = int(offsets[0]), int(offsets[-1])
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8, high - low, low).view(kind) if high > low else np.zeros(0, kind)
    return values, np.diff(offsets) // np.dtype(kind).itemsize


def _offsets(numbers: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(numbers)]).astype(np.int64)


def _ranges(starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    return np.repeat(starts - (np.cumsum(numbers) - numbers), numbers) + np.arange(int(numbers.sum()))


# 1. Segments by block -----------------------------------------------------------------------------------------------


def _segmented(docs: DataFrame, name: str, held, key: str, text: str, most: int) -> DataFrame:
    """Rows of texts (block, doc_id, seq: numbers of their segments) and of lists (block, low, segments: those from number ``low`` on)."""
    from pyspark import TaskContext

    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.binary()), ("low", pa.int32()), ("segments", pa.list_(pa.string()))])

    def scan(batches):
        pair, block = _pair(name, held), TaskContext.get().partitionId() << 32
        place, size = defaultdict(count().__next__), 0

        def lists():
            words = list(place)
            for low in range(0, len(words), LISTED):
                yield common.batch_of(schema, block=[block], doc_id=[None], seq=[None], low=[low], segments=[words[low : low + LISTED]])

        for batch in common.text_slices(batches, 4 << 20):
            rows = []
            for value in batch.column("text"):
                whole = value.as_py() or ""
                parts = pair.cut(whole) if whole else []
                rows.append(_planes(np.fromiter(map(place.__getitem__, parts), np.uint32, len(parts))))
                size += len(whole)
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), batch.column(0), pa.array(rows, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.list_(pa.string()))], schema=schema)
            if size >= most or len(place) >= BLOCK_SEGMENTS:
                yield from lists()
                block, place, size = block + 1, defaultdict(count().__next__), 0
        yield from lists()

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(scan, "block long, doc_id long, seq binary, low int, segments array<string>")


# 2. Distinct segments -----------------------------------------------------------------------------------------------


def _aligned(segments: DataFrame, name: str, sent) -> DataFrame:
    """segment and its alignment (``_packed``), which has no tokens where a tokenizer loses bytes."""

    def scan(batches):
        pair = _pair(name, sent)
        for batch in batches:
            held = sorted(batch.column(0).to_pylist(), key=lambda s: not s or s[-1].isspace())  # those that go alone come together
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), _packed(*pair.aligned(held)[:-1])], names=["segment", "data"])

    return segments.mapInArrow(scan, "segment string, data binary")


# 3. and 4. Blocks ---------------------------------------------------------------------------------------------------


class Block:
    """The alignments of a block's segments, by number; pairs of ids are numbers ``a * b_ids + b``."""

    def __init__(self, a, n_a, b, n_b, sizes, n_sizes, b_ids: int) -> None:
        self.a, self.b, self.n_a, self.n_b, self.same = a, b, n_a, n_b, n_a > 0
        self.sizes, self.n_groups = sizes.reshape(-1, 2), n_sizes // 2
        across = self.sizes[:, 0].astype(np.int64) * self.sizes[:, 1]
        self.n_links = np.diff(np.concatenate([[0], np.cumsum(across)])[_offsets(self.n_groups)])
        low_a, low_b = (_offsets(self.sizes[:, k])[:-1] for k in (0, 1))
        known, found, weights, numbers = [], [], [], np.zeros(len(across), np.int64)
        edges = np.unique([*range(0, len(across), STEP), *np.flatnonzero(across > WIDE), *(np.flatnonzero(across > WIDE) + 1), len(across)])
        for low, high in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            if across[low] > WIDE:  # a wide group alone: equal ids first
                (ua, ka), (ub, kb) = (np.unique(x[at[low] : at[low] + self.sizes[low, k]], return_counts=True) for k, (x, at) in enumerate(((a, low_a), (b, low_b))))
                key, weight = (ua.astype(np.int64)[:, None] * b_ids + ub[None, :]).ravel(), (ka[:, None] * kb[None, :]).ravel()
                numbers[low] = len(key)
            else:
                own = np.arange(low, high)
                numbers[low:high] = across[low:high]
                group = np.repeat(own, across[low:high])
                within, wide = _ranges(np.zeros(high - low, np.int64), across[low:high]), self.sizes[group, 1]
                key = a[low_a[group] + within // wide].astype(np.int64) * b_ids + b[low_b[group] + within % wide]
                weight = np.ones(len(key), np.int64)
            keys, inverse = np.unique(key, return_inverse=True)
            known.append(keys)
            found.append(inverse.astype(np.int32))
            weights.append(weight.astype(np.int32))
        self.pairs = np.unique(np.concatenate(known)) if known else np.zeros(0, np.int64)
        self.pair = np.concatenate([np.searchsorted(self.pairs, k)[i].astype(np.int32) for k, i in zip(known, found, strict=True)]) if known else np.zeros(0, np.int32)
        self.weight = np.concatenate(weights) if weights else np.zeros(0, np.int32)
        self.pair_offsets = np.concatenate([[0], np.cumsum(numbers)])[_offsets(self.n_groups)]
        self.seen = np.zeros(len(self.pairs), np.int64)
        self._mark, self._segment_mark = np.zeros(len(self.pairs), np.int64), np.zeros(len(n_a), np.int64)

    def count(self, seq: np.ndarray) -> None:
        """Count each pair that a text of these segments holds, once."""
        if not len(seq) or not self.same[seq].all():
            return
        self._segment_mark[seq] = np.arange(len(seq))
        own = seq[self._segment_mark[seq] == np.arange(len(seq))]
        numbers = self.pair_offsets[own + 1] - self.pair_offsets[own]
        pair = self.pair[_ranges(self.pair_offsets[own], numbers)]
        self._mark[pair] = np.arange(len(pair))
        self.seen[pair[self._mark[pair] == np.arange(len(pair))]] += 1

    def value(self, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> None:
        """Give the pairs their counts in the corpus: by segment, the sum over links and the links whose count is their A id's highest."""
        n, top = np.zeros(len(self.pairs), np.int64), np.zeros(len(self.pairs), np.int64)
        at = np.searchsorted(self.pairs, keys)
        n[at], top[at] = counts, best
        self.count_sum, self.n_best = (np.diff(np.concatenate([[0], np.cumsum(x[self.pair] * self.weight)])[self.pair_offsets]) for x in (n, top))

    def written(self) -> pa.Array:
        """The groups of each segment as text."""
        digits = lambda ids: pc.cast(pa.array(ids), pa.string())
        lists = lambda numbers, values: pa.ListArray.from_arrays(pa.array(_offsets(numbers), pa.int32()), values)
        sides = [pc.binary_join(lists(self.sizes[:, k], digits(x)), ",") for k, x in enumerate((self.a, self.b))]
        return pc.binary_join(lists(self.n_groups, pc.binary_join_element_wise(*sides, "|")), ";")


def _blocks(batches: Iterator[pa.RecordBatch], b_ids: int) -> Iterator[tuple[Block, int, pa.RecordBatch | None]]:
    """(block, its number, some of its texts), and (block, number, None) behind its last text.  Rows (block, kind, place, data, n) come by block,
    kind and place: values of pairs (0: pair, count and whether it is the highest in ``n``), alignments (1: number), texts (2: key)."""
    held: dict[str, list] = defaultdict(list)
    block, number = None, None

    def built() -> Block:
        parts = [_values(x.column("data"), np.uint16) for x in held["aligned"]]
        out = Block(*_unpacked(*(np.concatenate([p[k] for p in parts]) for k in (0, 1))), b_ids)
        if held["values"]:
            keys, n = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held["values"]]).astype(np.int64) for c in ("place", "n"))
            out.value(keys, n >> 1, n & 1)
        return out

    for batch in batches:
        ids, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind"))
        edges = np.flatnonzero((np.diff(ids) != 0) | (np.diff(kinds) != 0)) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
            if low == high:
                continue
            part, own, kind = batch.slice(low, high - low), int(ids[low]), int(kinds[low])
            if own != number:
                if block:
                    yield block, number, None
                held.clear()
                block, number = None, own
            if kind < 2:
                held["values" if kind == 0 else "aligned"].append(part)
            else:
                if block is None and held["aligned"]:
                    block = built()
                    held.clear()
                yield block, number, part
    if block:
        yield block, number, None


def _together(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.repartition("block").sortWithinPartitions("block", "kind", "place")


_COUNTED = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _counted(rows: DataFrame, b_ids: int) -> DataFrame:
    """block, pair, n: texts of the block that hold the pair linked."""

    def scan(batches):
        for block, number, texts in _blocks(batches, b_ids):
            if block is None:
                continue
            if texts is not None:
                for data in texts.column("data"):
                    block.count(_numbers(data))
            else:
                there = np.flatnonzero(block.seen)
                for low in range(0, len(there), 100_000):
                    part = there[low : low + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), pa.array(block.pairs[part]), pa.array(block.seen[part])], schema=_COUNTED)

    return rows.mapInArrow(scan, "block long, pair long, n long")


def _composed(rows: DataFrame, b_ids: int, groups: bool) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _NUMBERS), ("groups_sha256", pa.string()), *([("groups", pa.string())] if groups else [])])

    def scan(batches):
        known = written = None
        for block, number, texts in _blocks(batches, b_ids):
            if texts is None:
                continue
            if number != known:
                known, written = number, block.written() if block else None
            numbers = pc.fill_null(pc.binary_length(texts.column("data")), 0).to_numpy() // 4
            at, n = _offsets(numbers), texts.num_rows
            low = 0
            while low < n:
                high = max(low + 1, int(np.searchsorted(at, at[low] + TOGETHER, side="right")) - 1)
                seq, offsets = np.concatenate([_numbers(x) for x in texts.column("data").slice(low, high - low)]), at[low : high + 1] - at[low]
                by_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[seq])])[offsets])  # noqa: B023, E731
                sums = [by_text(getattr(block, c)) if block is not None else np.zeros(high - low, np.int64) for c in _NUMBERS]
                tokens = (numbers[low:high] > 0) & (by_text(~block.same) == 0 if block is not None else False)
                digests, strings = [], []
                for k in range(high - low):
                    sha, pieces = hashlib.sha256(), []
                    for begin in range(offsets[k], offsets[k + 1] if tokens[k] else offsets[k], TOGETHER):
                        own = seq[begin : min(begin + TOGETHER, offsets[k + 1])]
                        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), written.take(pa.array(own))), ";")[0]
                        pieces += [b";"] * bool(pieces) + [joined.as_buffer()]
                        for piece in pieces[-2:] if len(pieces) > 1 else pieces:
                            sha.update(piece)
                    digests.append(sha.hexdigest() if tokens[k] else "")
                    if groups:
                        strings.append(b"".join(pieces).decode())
                yield pa.RecordBatch.from_arrays([texts.column("place").slice(low, high - low), *(pa.array(np.where(tokens, s, 0), pa.int64()) for s in sums), pa.array(digests), *([pa.array(strings)] if groups else [])], schema=schema)
                low = high

    return rows.mapInArrow(scan, f"doc_id long, {', '.join(f'{c} long' for c in _NUMBERS)}, groups_sha256 string" + ", groups string" * groups)


# The operator -------------------------------------------------------------------------------------------------------


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """What a job has shuffled is deleted when the job has ended: its result is stored, and nothing reads the shuffle again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Alignment:
    """Steps 1 to 3, stored: ``pairs`` (a, b, n, best: the linked ids, the texts that hold them, and whether n is the highest of a), and
    ``texts``, one row for each text."""

    def __init__(self, docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> None:
        spark = docs.sparkSession
        with open(a, encoding="utf-8") as f, open(b, "rb") as g:
            held = f.read(), g.read()
        name = hashlib.sha256(held[0].encode() + held[1]).hexdigest()
        self.b_ids = len(Pair(*held).b_bytes)
        sent = spark.sparkContext.broadcast(held)  # the size of two vocabularies
        with _tidy(spark):
            texts = common.staged(_segmented(docs, name, sent, key, text, block), "segmented", "zstd")
            listed = texts.filter("segments IS NOT NULL").select("block", "low", F.posexplode("segments").alias("place", "segment")).select("block", (F.col("low") + F.col("place")).cast("long").alias("place"), "segment")
            distinct, at = common.staged_at(_aligned(listed.select("segment").distinct(), name, sent), "aligned", "zstd")
            none = F.lit(None).cast("long").alias("n")
            self._joined = common.staged(listed.join(distinct, "segment").select("block", F.lit(1).alias("kind"), "place", "data", none), "aligned-by-block", "zstd")
            common.removed(spark, at)
            self._rows = texts.filter("segments IS NULL").select("block", F.lit(2).alias("kind"), F.col("doc_id").alias("place"), F.col("seq").alias("data"), none)
            self._seen = common.staged(_counted(_together([self._joined, self._rows]), self.b_ids), "pairs-by-block", "zstd")
            sums = self._seen.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", ((F.col("pair") - F.col("pair") % self.b_ids) / self.b_ids).cast("long"))
            tops = sums.groupBy("a").agg(F.max("n").alias("top"))
            self._values = common.staged(sums.join(tops, "a").select("pair", "a", "n", (F.col("n") == F.col("top")).alias("best")), "pair-counts")

    @property
    def pairs(self) -> DataFrame:
        return self._values.select("a", (F.col("pair") % self.b_ids).alias("b"), "n", "best")

    def texts(self, groups: bool = False) -> DataFrame:
        values = self._seen.select("block", "pair").join(self._values, "pair").select("block", F.lit(0).alias("kind"), F.col("pair").alias("place"), F.lit(None).cast("binary").alias("data"), (F.col("n") * 2 + F.col("best").cast("long")).alias("n"))
        return _composed(_together([values, self._joined, self._rows]), self.b_ids, groups)


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", groups: bool = False, block: int = BLOCK) -> DataFrame:
    """Alignment of every whole text by tokenizers ``a`` (a tokenizers file, byte-level BPE) and ``b`` (a sentencepiece model): doc_id, n_a,
    n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with ``groups`` the groups as text.

    A null or empty text, and one whose bytes are not kept by both tokenizers (a text with U+2581), has no tokens: zeros and an empty
    digest.  Rows, ties, repeats and null keys stay one to one, each row counts as a document; other columns aren't read; an empty
    table gives no rows.
    """
    return Alignment(docs, a, b, key, text, block).texts(groups)
