"""Byte-level BPE by monoid tree reduction.

A text is halved down to leaves.  A leaf is cut at *hard boundaries*: a space between two characters that are not white
space.  No alternative of the splitting pattern spans the step from a non-space to a space, so a hard boundary ends a
pattern match in any context, and segments between two of them encode alike wherever they stand.  Only the outer edges of
an encoded span are open.  Joining two spans re-encodes the window from the last hard boundary on the left to the first one
on the right; where a span has no boundary the window takes in all of it and so grows up the tree.

Inside one pattern match (a word, or a long run without spaces) the same monoid works on tokens: halves are encoded and
joined by re-encoding a window of tokens about the seam, which doubles until the tokens on both of its rims stand in pairs
that BPE leaves apart.  A sequence all of whose neighbours are such pairs is the encoding of its bytes: the first merge over
a border would also happen in the pair alone.

Decoding concatenates token bytes up a tree of the same shape.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Characters in a leaf of the text tree, bytes in a leaf of the token tree.
TEXT_LEAF, TOKEN_LEAF = 2048, 16
#: Segments, and byte strings of up to ``SHORT`` bytes, that one worker remembers; a memory starts anew beyond that.
MEMORY, SHORT = 400_000, 12

_HARD = re.compile(r"(?<=\S)(?= \S)")
_SOFT = re.compile(r" \s|\s ")


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class TreeBpe:
    """Encoder and decoder for one vocabulary; spans of text and of tokens are monoids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.apart = lru_cache(200_000)(self._apart)
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.small: dict[bytes, list[int]] = {}

    # tokens -----------------------------------------------------------------------------------------------------

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: the lowest rank first, the leftmost of equals; over short strings by the least of a list, over others
        by a heap and a linked list of parts."""
        ranks, n = self.ranks, len(data)
        if n < 2:
            return [ranks[data]] if n else []
        if n <= 2 * TOKEN_LEAF:
            none, rank_of = 1 << 60, ranks.get
            parts = [data[i : i + 1] for i in range(n)]
            pairs = [rank_of(data[i : i + 2], none) for i in range(n - 1)]
            while pairs and (rank := min(pairs)) < none:
                i = pairs.index(rank)
                parts[i] += parts[i + 1]
                del parts[i + 1], pairs[i]
                if i < len(pairs):
                    pairs[i] = rank_of(parts[i] + parts[i + 1], none)
                if i:
                    pairs[i - 1] = rank_of(parts[i - 1] + parts[i], none)
            return [ranks[p] for p in parts]
        after, before, part = list(range(1, n + 1)), list(range(-1, n - 1)), [data[i : i + 1] for i in range(n)]
        heap = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if j >= n or not part[i] or len(part[i]) + len(part[j]) != size:
                continue
            part[i], part[j] = part[i] + part[j], b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (rank, i, size + len(part[k])))
            if (h := before[i]) >= 0 and (rank := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (rank, h, size + len(part[h])))
        return [ranks[p] for p in part if p]

    def _merged(self, data: bytes) -> list[int]:
        """``merged``, remembered for short strings: leaves and windows of the tree come again and again."""
        found = self.small.get(data)
        if found is None:
            found = self.merged(data)
            if len(data) <= SHORT:
                if len(self.small) >= MEMORY:
                    self.small.clear()
                self.small[data] = found
        return found

    def _apart(self, left: int, right: int) -> bool:
        """Does BPE leave this pair of tokens as it is?"""
        return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring encoded spans."""
        if not left or not right:
            return left + right
        if self.apart(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self._merged(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            stable_left = i >= len(left) or self.apart(left[-i - 1], window[0])
            stable_right = j >= len(right) or self.apart(window[-1], right[j])
            if stable_left and stable_right:
                return left[: len(left) - i] + window + right[j:]
            i = i if stable_left else min(len(left), 2 * i)
            j = j if stable_right else min(len(right), 2 * j)

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= TOKEN_LEAF:
            return self._merged(data)
        half = len(data) // 2
        return self.joined(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, text: str) -> list[int]:
        data = text.encode()
        whole = self.ranks.get(data)
        return self.tree(data) if whole is None else [whole]

    # text -------------------------------------------------------------------------------------------------------

    def segment(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids as text, and their bytes, of a text between hard boundaries."""
        found = self.known.get(text)
        if found is None:
            # letters alone, after a space or not, are one match of the pattern
            pieces = [text] if text.isascii() and text[text[0] == " " :].isalpha() else self.pieces(text)
            ids = [i for piece in pieces for i in self.piece(piece)]
            found = len(ids), " ".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids))
            if len(text) <= 64:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[text] = found
        return found

    def _leaf(self, text: str) -> tuple[str, str, list]:
        if text[0] == " " or text[-1] == " " or _SOFT.search(text):
            parts = _HARD.split(text)
        else:  # every space is a hard boundary
            parts = text.split(" ")
            parts[1:] = [" " + p for p in parts[1:]]
        known, segment = self.known.get, self.segment
        return parts[0], parts[-1], [known(p) or segment(p) for p in parts]

    def _join(self, left: tuple, right: tuple) -> tuple[str, str, list]:
        parts = _HARD.split(left[1] + right[0])
        first = left[0] if len(left[2]) > 1 else parts[0]
        last = right[1] if len(right[2]) > 1 else parts[-1]
        encoded = left[2]
        encoded[-1:] = map(self.segment, parts)
        encoded += right[2][1:]
        return first, last, encoded

    def _span(self, text: str, low: int, high: int) -> tuple[str, str, list]:
        if high - low <= TEXT_LEAF:
            return self._leaf(text[low:high])
        half = (low + high) // 2
        return self._join(self._span(text, low, half), self._span(text, half, high))

    def encode(self, text: str) -> list[tuple[int, str, bytes]]:
        return self._span(text, 0, len(text))[2] if text else []

    def ids(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encode(text) for i in ids.split()]

    def decode(self, encoded: list[tuple[int, str, bytes]]) -> bytes:
        if len(encoded) <= 512:
            return b"".join([e[2] for e in encoded])
        half = len(encoded) // 2
        return self.decode(encoded[:half]) + self.decode(encoded[half:])


_OUT = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_encoders: dict[str, TreeBpe] = {}


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Encode and decode every whole ``text``: key, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the token ids.

    A null or empty text has no tokens (both digests are those of no bytes); rows, ties and repeats stay one to one; other
    columns are not read; an empty table gives no rows.  The rank file is read on the driver and sent as one broadcast (its size is that of a vocabulary).
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    name = hashlib.sha256(data.value + pattern.encode()).hexdigest()
    kind = docs.schema[key].dataType

    def scan(batches):
        if name not in _encoders:
            _encoders[name] = TreeBpe(ranks_of(data.value), pattern)
        bpe = _encoders[name]
        for batch in common.text_slices(batches, 8 << 20):
            counts, hashes, decoded, all_ids = [], [], [], []
            for text in batch.column("text"):
                encoded = bpe.encode(text.as_py() or "")
                joined = " ".join([e[1] for e in encoded])
                counts.append(sum([e[0] for e in encoded]))
                hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(encoded)).hexdigest())
                if ids:
                    all_ids.append([int(i) for i in joined.split()])
            own = pa.RecordBatch.from_pydict({"n_tokens": counts, "ids_sha256": hashes, "decoded_sha256": decoded}, schema=_OUT)
            columns = [batch.column(0), *own.columns] + ([pa.array(all_ids, pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=[key, *_OUT.names] + ["ids"] * ids)

    schema = f"`{key}` {kind.simpleString()}, {_FIELDS}" + ", ids array<int>" * ids
    return docs.select(docs[key], docs["text"]).mapInArrow(scan, schema)
