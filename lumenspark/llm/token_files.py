"""Token ids in bit-packed files.

An image is a header, block offsets, document offsets and the packed ids: each id takes the bits that the vocabulary needs,
blocks of ``BLOCK`` ids start at whole bytes at known offsets, so numpy unpacks any block alone.  The rows of a partition
become images of about ``IMAGE_TOKENS`` ids.  Images are stored through Spark's writer in the shared folder (any file
system, committed once, safe to retry); ``dump`` writes them as plain files where a local copy is wanted.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Format name and version; ids in a block; ids after which an image is closed.
MAGIC, BLOCK, IMAGE_TOKENS = b"TOKBITS1", 4096, 1 << 20
_HEAD = struct.Struct("<8sIIQQ")
#: Bytes that a worker's memory of words may take before it starts anew, and those of a word besides its string and ids.
MEMORY_BYTES, ENTRY_BYTES = 96 << 20, 110
#: Words between marks that the library gets in one text, and the characters beyond which a word goes by itself.
TOGETHER, LONG = 100, 1000
#: Bytes of text whose words are looked up at once.
SLICE_BYTES = 4 << 20
#: Latin letters (but for the dotted capital I, whose lower case is no single letter), then ASCII punctuation: a token group each.
LETTERS, PUNCTUATION = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", "!-/:-@\\[-`{-~"
_PARTS = f"^(?P<letters>[{LETTERS}]+)(?P<behind>[{PUNCTUATION}]*)$"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """Bits of each id, lowest first, without gaps."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = ((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpacked(data: memoryview, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def image(lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    blocks = [packed(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    docs = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    return _HEAD.pack(MAGIC, bits, BLOCK, len(ids), len(lengths)) + offsets.tobytes() + docs.tobytes() + b"".join(blocks)


class Image:
    """Random access to the ids in an image (bytes, or a memory map of a file)."""

    def __init__(self, data) -> None:
        self.data = memoryview(data)
        magic, self.bits, self.block, self.n_ids, self.n_docs = _HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a token image")
        n, at = -(-self.n_ids // self.block), _HEAD.size
        self.offsets = np.frombuffer(self.data, "<u8", n + 1, at)
        self.docs = np.frombuffer(self.data, "<u8", self.n_docs + 1, at + 8 * (n + 1))
        self.start = at + 8 * (n + 1) + 8 * (self.n_docs + 1)

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        return unpacked(self.data[self.start + int(self.offsets[k]) : self.start + int(self.offsets[k + 1])], n, self.bits)

    def ids(self, low: int, high: int) -> np.ndarray:
        if low >= high:
            return np.zeros(0, np.uint32)
        first = low // self.block
        parts = [self.read_block(k) for k in range(first, -(-high // self.block))]
        return np.concatenate(parts)[low - first * self.block : high - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.docs[k]), int(self.docs[k + 1]))


class WordEncoder:
    """Ids by the tokenizers library, word by word.

    The vocabulary's own rules drop white space and never look past it, so the ids of a text are those of its words one
    after another; a word is what stands between spaces, tabs and line breaks, all else is left to the library.  Words are
    remembered, up to ``MEMORY_BYTES``, and ids gathered with numpy; Latin words by their lower-case letters and by the
    punctuation behind them, where the vocabulary's rules keep these apart.  New words go to the library many in a text: words
    of letters alone are one token group each, whose last id ends a word, so their ids can be told apart; others have a
    special token between them.
    """

    #: Stands for the end of a document; no word has a space.
    END = " "
    #: Places of the empty word, which has no ids, and of the end.
    EMPTY_AT, END_AT = 0, 1

    def __init__(self, data: str, end: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_str(data), end
        encoded = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if json.loads(data)["model"].get("end_of_word_suffix") != "</w>" or encoded(" One\t\n two's ") != [i for w in ("One", "two's") for i in encoded(w)]:
            raise ValueError("a tokenizer that drops white space and marks the ends of words is needed")
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(1 + max(vocabulary.values()), bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.mark_id, self.mark = max((i, str(t)) for i, t in self.tokenizer.get_added_tokens_decoder().items())
        self.parted = self._parts_stand_alone()
        self._clear()

    def _parts_stand_alone(self) -> bool:
        """Whether letters in either case and the punctuation behind them have ids of their own, and no added token is in such a word."""
        encoded = lambda words: self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
        letters, marks = ([chr(i) for i in range(0x250) if re.match(f"[{kind}]", chr(i))] for kind in (LETTERS, PUNCTUATION))
        parts = [(a, b) for a in letters for b in marks] + [("ab", a + b) for a in marks for b in marks]
        added = map(str, self.tokenizer.get_added_tokens_decoder().values())
        return all(re.search(r"[^\w\s]\w", t) for t in added) and encoded(map("".join, parts)) == encoded(x for a, b in parts for x in (a.lower(), b))

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.low, self.n, self.pool, self.used, self.held_bytes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 0, 0
        self._add(["", self.END], np.array([0, 1]), np.array([self.end], np.uint32))

    def _add(self, words: list[str], n: np.ndarray, flat: np.ndarray) -> None:
        k = len(self.place)
        while k + len(words) > len(self.low):
            self.low, self.n = np.concatenate([self.low, np.zeros_like(self.low)]), np.concatenate([self.n, np.zeros_like(self.n)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.low[k : k + len(words)], self.n[k : k + len(words)] = self.used + np.cumsum(n) - n, n
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.held_bytes += sum(map(sys.getsizeof, words)) + ENTRY_BYTES * len(words) + 2 * flat.nbytes
        self.place.update(zip(words, range(k, k + len(words)), strict=True))

    def _alone(self, words: list[str]) -> None:
        """Add words whose ids do not show where they end: a special token, which no other word gives, stands between them
        and is cut out again; words that hold its text, and long ones, go to the library by themselves."""
        by_itself = [w for w in words if len(w) > LONG or self.mark in w]
        if by_itself:
            words = [w for w in words if len(w) <= LONG and self.mark not in w]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(by_itself, add_special_tokens=False)]
            n = np.fromiter(map(len, found), np.int64, len(found))
            self._add(by_itself, n, np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())))
        for i in range(0, len(words), TOGETHER):
            part = words[i : i + TOGETHER]
            flat = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            marks = flat == self.mark_id
            self._add(part, np.diff(np.flatnonzero(marks), prepend=-1, append=len(flat)) - 1, flat[~marks])

    def _learn(self, words: list[str]) -> None:
        letters, others = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        for i in range(0, len(letters), 500):
            part = letters[i : i + 500]
            flat = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[flat])
            if len(ends) == len(part) and ends[-1] == len(flat) - 1:
                self._add(part, np.diff(ends, prepend=-1), flat)
            else:
                others += part
        self._alone(others)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of each word are, or of its two parts, of which the second may be empty."""
        parts = [words]
        if self.parted:
            found, empty = pc.extract_regex(words, _PARTS), pa.scalar("", words.type)
            parts = [pc.if_else(found.is_valid(), part, other) for part, other in ((pc.utf8_lower(found.field("letters")), words), (found.field("behind"), empty))]
        coded = pa.concat_arrays(parts).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [w for w in distinct if w not in self.place]:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        return at.reshape(len(parts), -1).T

    def _gathered(self, low: np.ndarray, n: np.ndarray, pool: np.ndarray) -> np.ndarray:
        return pool[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths with the end id, and all ids one after another."""
        if self.held_bytes > MEMORY_BYTES:
            self._clear()
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        for space in "\t\n\r":
            texts = pc.replace_substring(texts, space, " ")
        rows = pc.split_pattern(texts, " ")
        distinct = rows.flatten().dictionary_encode()
        # the ids of the words of these texts side by side, the end behind them
        at = self._places(distinct.dictionary)
        at = np.concatenate([at, [[self.END_AT] + [self.EMPTY_AT] * (at.shape[1] - 1)]])
        pool, n = self._gathered(self.low[at.ravel()], self.n[at.ravel()], self.pool), self.n[at].sum(1)
        low = np.cumsum(n) - n
        ends = np.cumsum(pc.list_value_length(rows).to_numpy())
        held = np.insert(distinct.indices.to_numpy(), ends, len(n) - 1)
        n = n[held]
        starts = np.concatenate([[0], ends[:-1]]) + np.arange(len(ends))
        return np.add.reduceat(n, starts), self._gathered(low[held], n, pool)


_encoders: dict[str, WordEncoder] = {}


def _encoder(name: str, data, end: int) -> WordEncoder:
    """The encoder of this worker for all its tasks.  It is a function of the module because what ``mapInArrow`` gets is sent by
    value with the globals that it names: a dict named there would be a new one in each task, and its encoders would pile up."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = WordEncoder(data.value, end)
    return _encoders[name]


_IMAGES = "part int, image int, first_id long, n_ids long, keys array<long>, data binary"
_READ = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_images(docs: DataFrame, tokenizer: str, end: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and store the images; returns the stored table.

    Equal doc_ids stand in the order in which the table has them (so rows of one id, or of none, fill many partitions), nulls come first; a null text is empty and has the end id alone; repeated
    rows are stored as often as they come; other columns aren't read; an empty table gives no image.
    """
    import hashlib

    from pyspark import TaskContext

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    WordEncoder(text, end)  # refuses other tokenizers before any task runs
    data, bits = spark.sparkContext.broadcast(text), bits_for(1 + max(max(json.loads(text)["model"]["vocab"].values()), end))

    name = hashlib.sha256(f"{end} {text}".encode()).hexdigest()

    def scan(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, part, k, first = _encoder(name, data, end), TaskContext.get().partitionId(), 0, 0
        keys, lengths, ids, held = [], [], [], 0

        def closed():
            n = np.concatenate(lengths)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "image": pa.array([k], pa.int32()), "first_id": [first], "n_ids": [held], "keys": pa.array([keys], pa.list_(pa.int64())), "data": pa.array([image(n, np.concatenate(ids), bits)], pa.binary())})

        for batch in common.text_slices(batches, SLICE_BYTES):
            n, flat = encoder.encode(batch.column("text"))
            keys += batch.column("doc_id").to_pylist()
            lengths.append(n)
            ids.append(flat)
            held += len(flat)
            if held >= IMAGE_TOKENS:
                yield closed()
                k, first, keys, lengths, ids, held = k + 1, first + held, [], [], [], 0
        if keys:
            yield closed()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.monotonically_increasing_id().alias("place"))
    order = F.col("doc_id").asc_nulls_first(), F.col("place")
    n = partitions or max(docs.rdd.getNumPartitions() * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("place")
    return common.staged(ordered.mapInArrow(scan, _IMAGES), "token-images")


def read_images(images: DataFrame) -> DataFrame:
    """Unpack every document from the stored images: doc_id, start, n_tokens, ids_crc32; without images no rows."""

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                held = Image(row["data"])
                all_ids, docs = held.ids(0, held.n_ids).astype("<u4"), held.docs.astype(np.int64)
                raw, n = memoryview(all_ids).cast("B"), held.n_docs
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array(docs[:-1] + row["first_id"]), pa.array(np.diff(docs)), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(docs[:-1], docs[1:], strict=True)], pa.int64())], schema=_READ)

    # one row for each write partition, so a fixed number of rows whatever the input
    totals = images.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    found = images.mapInArrow(scan, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(before), F.col("part") == F.col("p")).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def dump(images: DataFrame, folder: str) -> list[str]:
    """Write the images as files in a folder of this machine, one at a time; ``Image(np.memmap(path))`` opens one."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    paths = []
    for row in images.select("part", "image", "data").orderBy("part", "image").toLocalIterator():
        paths.append(str(Path(folder) / f"{row.part:06d}-{row.image:04d}.tok"))
        Path(paths[-1]).write_bytes(row.data)
    return paths
