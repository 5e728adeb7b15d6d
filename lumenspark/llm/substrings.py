"""Removal of repeated substrings of a fixed length over a whole corpus, and the words of passages that documents share.

Every window of ``length`` bytes picks an anchor: its gram with the least hash (the rightmost of equals).  Equal windows pick
the same anchor at the same distance, so windows need to be compared only among occurrences of one anchor gram.  Passages of
``passage`` words are found alike: their characters are words, known by hashes.

1. Texts are known by digests; of equal texts one stands for all (a text of at least ``length`` bytes that occurs twice goes
   wholly).  The anchor grams of each text are listed, about one for each 170 bytes and one for each 20 words.
2. Grams that occur once are dropped.  The windows about the others are taken from the texts.
3. The occurrences of a gram are sorted deep-shallow by what follows and what precedes, which gives the repeated windows.
   A gram with more occurrences than a block holds is sorted in blocks; of what a block has once or more it sends each window
   once, by digest, to be met with those of other blocks.  So a passage that very many texts share meets in no one task.
4. Windows are united to spans in each text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import _powers, mixed, text_bytes, words
from .suffixes import repeats

#: Bytes of an anchor gram; windows handled at once in a text; occurrences of a gram that one block holds.
GRAM, WINDOWS, BLOCK = 64, 1 << 19, 2000
#: Words of an anchor gram of passages; bytes of a word's hash in the sorter.
WORD_GRAM, UNIT = 10, 4
#: Grams of several blocks that are broadcast (16 bytes each).
BROADCAST_GRAMS = 800_000

_BYTE = np.random.default_rng(20240502).integers(0, 1 << 64, 256, np.uint64)
_LOW = np.uint64((1 << 20) - 1)
_ODD = np.uint64(1)


def _rolled(values: np.ndarray, gram: int) -> np.ndarray:
    n = len(values)
    if n < gram:
        return np.zeros(0, np.uint64)
    up, down = _powers(max(1 << 21, 1 << (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of all grams of bytes; even, so that they never equal those of words."""
    return _rolled(_BYTE[raw], gram) & ~_ODD


def word_grams(word: np.ndarray, gram: int = WORD_GRAM) -> np.ndarray:
    return _rolled(word, gram) | _ODD


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows, from minima running through blocks in both directions."""
    n = len(keys)
    blocks = np.full((-(-n // width), width), np.uint64(2**64 - 1))
    blocks.ravel()[:n] = keys
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of texts that lie one after another, each from ``low`` to ``high``: the number of the text, the place of the anchor,
    and the first and last start of the windows that pick it.  ``hashes`` are of all grams, also across texts."""
    width = length - gram + 1
    windows = len(hashes) - width + 1
    long = np.flatnonzero(high - low >= length)
    if windows < 1 or not len(long):
        return (np.zeros(0, np.int64),) * 4
    parts = []
    for c in range(0, windows, WINDOWS):
        own = hashes[c : min(c + WINDOWS, windows) + width - 1]
        keys = (own & ~_LOW) | (_LOW - np.arange(len(own), dtype=np.uint64))
        parts.append((_LOW - (_least(keys, width) & _LOW)).astype(np.int64) + c)
    inside = np.zeros(windows + 1, np.int8)
    inside[low[long]] += 1
    inside[high[long] - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    place = np.concatenate(parts)[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return long[np.searchsorted(low[long], start[first], "right") - 1], place[first], start[first], start[last]


def _listed(docs: DataFrame, length: int, passage: int) -> DataFrame:
    """A row for each document (doc_id, n, w, sha, k), and rows (g, k, times) for the anchor grams of texts; k: a key of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("w", pa.int64()), ("sha", pa.binary()), ("k", pa.int64()), ("g", pa.int64()), ("times", pa.int64())])

    def scan(batches):
        seen: set[bytes] = set()
        for batch in common.text_slices(batches):
            raw, at = text_bytes(batch.column("text"))
            word, before = words(raw, at)
            hashes, grams = gram_hashes(raw), word_grams(word)
            shas, new = [], []
            for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                shas.append(hashlib.sha256(raw[low:high]).digest())
                if shas[-1] not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(shas[-1])
                    new.append(len(shas) - 1)
            keys = np.array([int.from_bytes(sha[:8], "little", signed=True) for sha in shas], np.int64)
            found = []
            for own, places, size, gram in ((hashes, at, length, GRAM), (grams, before, passage, WORD_GRAM)):
                doc, place, _, _ = anchors(own, places[:-1][new], places[1:][new], size, gram)
                g = own[place].view(np.int64)
                order = np.lexsort((g, doc))
                doc, g = doc[order], g[order]
                first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])])) if len(g) else np.zeros(0, np.int64)
                found.append((g[first], keys[np.array(new, np.int64)[doc[first]]], np.diff(np.append(first, len(g)))))
            none = pa.nulls(len(shas), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(before)), pa.array(shas, pa.binary()), pa.array(keys, pa.int64()), none, none], schema=schema)
            g, k, times = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(g):
                none = pa.nulls(len(g), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(g), pa.binary()), pa.array(k), pa.array(g), pa.array(times)], schema=schema)

    return common.staged(docs.mapInArrow(scan, "doc_id long, n long, w long, sha binary, k long, g long, times long"), "anchors")


def _wanted(listed: DataFrame, slim: DataFrame) -> tuple[DataFrame, bool]:
    """rep, sha and anchors (g and its number of blocks) of each text with repeated grams; and are there grams of several blocks?"""
    marks = listed.filter("sha is null").select("g", "k", "times")
    ends = marks.groupBy("g").agg(F.min("k").alias("p"), F.max("k").alias("q"), F.max("times").alias("most"), F.sum("times").alias("c"))
    # what one text alone repeats counts for bytes only
    twice = common.staged(ends.filter("p <> q or (most > 1 and g % 2 = 0)").select("g", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "grams")
    hot = twice.filter("blocks > 1")
    few = hot.count()
    joined = marks.join(twice, "g")
    if 0 < few <= BROADCAST_GRAMS:
        hot = F.broadcast(hot)
        joined = marks.join(hot, "g", "left_anti").join(twice.filter("blocks = 1"), "g").unionByName(marks.join(hot, "g"))
    lists = joined.groupBy("k").agg(F.collect_list(F.struct("g", "blocks")).alias("anchors"))
    groups = slim.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.first("k").alias("k"))
    return common.staged(groups.join(lists, "k").select("rep", "sha", "anchors"), "wanted"), few > 0


def _regions(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sha, text and anchors of texts with repeated grams; one row for each distinct text."""
    found = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"])).filter(F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)) == F.col("sha"))
    return common.staged(found.select("sha", "text", "anchors").dropDuplicates(["sha"]), "texts")


def _bytes_of(texts: DataFrame, length: int, passage: int) -> DataFrame:
    """g, block, blocks, sha, a, low and the bytes (or hashes of words) of its windows, for each occurrence of a repeated anchor."""
    schema = pa.schema([("g", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("sha", pa.binary()), ("a", pa.int64()), ("low", pa.int64()), ("region", pa.binary())])

    def scan(batches):
        for batch in common.text_slices(batches):
            raw, at = text_bytes(batch.column("text"))
            word, before = words(raw, at)
            hashes, grams = gram_hashes(raw), word_grams(word)
            short = (word >> np.uint64(32)).astype("<u4").tobytes()
            data = raw.tobytes()
            shas = batch.column("sha").to_pylist()
            blocks = [{x["g"]: x["blocks"] for x in found} for found in batch.column("anchors").to_pylist()]
            out = []
            for own, places, size, gram, source, unit in ((hashes, at, length, GRAM, data, 1), (grams, before, passage, WORD_GRAM, short, UNIT)):
                doc, place, first, last = anchors(own, places[:-1], places[1:], size, gram)
                starts = places[doc]
                for i, g, a, low, high, start in zip(doc.tolist(), own[place].view(np.int64).tolist(), place.tolist(), first.tolist(), last.tolist(), starts.tolist(), strict=True):
                    n = blocks[i].get(g)
                    if n:
                        block = (int.from_bytes(shas[i][8:12], "little") + a - start) % n if n > 1 else 0
                        out.append((g, block, n, shas[i], a - start, low - start, source[low * unit : (high + size) * unit]))
            for i in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 2000], strict=True), schema.types, strict=True)], schema=schema)

    return texts.mapInArrow(scan, "g long, block int, blocks int, sha binary, a long, low long, region binary")


_STARTS = pa.schema([("words", pa.bool_()), ("sha", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("window", pa.binary())])


def _sorted_repeats(regions: DataFrame, length: int, passage: int, split: bool) -> DataFrame:
    """words (or bytes), sha, first and last starts of repeated windows, from sorting the occurrences of each gram."""

    def solved(rows):
        of_words = rows[0][0] % 2 == 1
        unit, size = (UNIT, passage) if of_words else (1, length)
        entries = [(r[6], (r[4] - r[5]) * unit) for r in rows]
        out = []
        for row, spans in zip(rows, repeats(entries, size * unit, [r[3] for r in rows] if of_words else None, unit), strict=True):
            out += [(of_words, row[3], row[4] - high // unit, row[4] - least // unit, None) for least, high in spans]
        return out

    def sent(rows):
        """Windows for other blocks: with text and start where this block has them once (words: in one text), else alone."""
        of_words = rows[0][0] % 2 == 1
        unit, size = (UNIT, passage) if of_words else (1, length)
        held: dict[bytes, list] = {}
        for _, _, _, sha, _, low, region in rows:
            for k in range(len(region) // unit - size + 1):
                window = hashlib.blake2b(region[k * unit : (k + size) * unit], digest_size=16, person=b"words" if of_words else b"bytes").digest()
                places = held.setdefault(window, [])
                if places is not None:
                    if places and (not of_words or places[0][0] != sha):
                        held[window] = None
                    else:
                        places.append((sha, low + k))
        for window, places in held.items():
            for sha, start in places if places is not None else [(None, None)]:
                yield of_words, sha, start, start, window

    def scan(batches):
        now, rows, out = None, [], []

        def batch_of(part):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _STARTS.types, strict=True)], schema=_STARTS)

        def ended():
            if len(rows) > 1:
                out.extend(solved(rows))
            if rows and rows[0][2] > 1:
                out.extend(sent(rows))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "block", "blocks", "sha", "a", "low", "region")), strict=True):
                if row[:2] != now:
                    ended()
                    now, rows = row[:2], []
                    while len(out) > 10_000:
                        yield batch_of(out[:10_000])
                        del out[:10_000]
                rows.append(row)
        ended()
        for i in range(0, len(out), 10_000):
            yield batch_of(out[i : i + 10_000])

    found = regions.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(scan, "words boolean, sha binary, first long, last long, window binary")
    if not split:
        return found.drop("window")
    found = common.staged(found, "starts")
    sent_ = found.filter("window is not null")
    met = sent_.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.count("sha").alias("known"), F.min("sha").alias("p"), F.max("sha").alias("q"), F.first("words").alias("of_words"))
    met = met.filter("known > 0 and if(of_words, known < n or p <> q, n > 1)").select("window")
    return found.filter("window is null").drop("window").unionByName(sent_.filter("sha is not null").join(met, "window").drop("window"))


def _removed(texts: DataFrame, starts: DataFrame, length: int, passage: int) -> DataFrame:
    """n_removed, n_spans, kept_sha256, spans and n_passage_words of each text with repeated windows."""
    spans = starts.distinct().groupBy("sha").agg(F.collect_list(F.struct("words", "first", "last")).alias("starts"))
    schema = pa.schema([("sha", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("n_passage_words", pa.int64())])

    def united(places):
        out = []
        for low, high in sorted(places):
            if out and low <= out[-1][1]:
                out[-1][1] = max(out[-1][1], high)
            else:
                out.append([low, high])
        return out

    def scan(batches):
        for batch in common.text_slices(batches):
            out = []
            for sha, text, found in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "starts")), strict=True):
                raw = text.encode()
                gone = united((x["first"], x["last"] + length) for x in found if not x["words"])
                shared = united((x["first"], x["last"] + passage) for x in found if x["words"])
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((sha, sum(b - a for a, b in gone), len(gone), kept.hexdigest(), gone, sum(b - a for a, b in shared)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return texts.select("sha", "text").join(spans, "sha").mapInArrow(scan, "sha binary, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, n_passage_words long")


def repeated(docs: DataFrame, length: int = 400, passage: int = 51) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets; null: the whole text) and n_passage_words of every
    document.

    Bytes of windows that start anywhere else too are removed; texts shorter than ``length``, null and empty ones lose
    nothing; equal rows are copies of each other and go; repeated doc_ids stay one to one; other columns aren't read; an
    empty table gives no rows.  n_passage_words: words within runs of ``passage`` words (A-Z as a-z, any white space between)
    that a second document has too.  Such a passage may be shorter than ``length`` bytes; nothing is removed by it.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    listed = _listed(docs, length, passage)
    slim = listed.filter("sha is not null").select("doc_id", "n", "w", "sha", "k")
    wanted, split = _wanted(listed, slim)
    texts = _regions(docs, wanted)
    starts = _sorted_repeats(_bytes_of(texts, length, passage), length, passage, split)
    removed = _removed(texts, starts, length, passage).dropDuplicates(["sha"])
    copies = common.staged(slim.groupBy("sha").count().filter("count > 1"), "copies")
    many = copies.filter(F.col("count") > BLOCK).select("sha")
    again = F.lit(True)
    rest, hot = slim, slim.limit(0).withColumn("again", again)
    if 0 < many.count() <= BROADCAST_GRAMS:  # texts of very many copies go wholly or have nothing to go: their rows join no table
        rest, hot = slim.join(F.broadcast(many), "sha", "left_anti"), slim.join(F.broadcast(many), "sha", "left_semi").withColumn("again", again)
    out = rest.join(copies.select("sha", again.alias("again")), "sha", "left").join(removed, "sha", "left").unionByName(hot, allowMissingColumns=True)
    whole = F.col("again").isNotNull() & (F.col("n") >= length)
    shared = F.col("again").isNotNull() & (F.col("w") >= passage)
    return out.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(~whole, F.coalesce("spans", F.expr("cast(array() as array<array<bigint>>)"))).alias("spans"),
        F.when(shared, F.col("w")).otherwise(F.coalesce("n_passage_words", F.lit(0))).cast("long").alias("n_passage_words"),
    )
