"""Fill-in-the-middle transformation by a table-driven byte automaton.

One table of (state, byte class) follows UTF-8 continuation, the begin of units (code points) and the sentinels at once.  What
is scanned is cut into strips of equal length, which all go through the table in lockstep, a column of bytes at a time.  The
state after ``WARM`` bytes does not depend on what came before them, so a strip starts that many bytes early.  The first pass
keeps two counts for each strip: transitions that begin a unit and transitions that end a sentinel.  A second pass goes through
the strips that hold a wanted unit, or a sentinel, and gives its place in bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from . import common

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a strip, and bytes that one window of strips holds.
STRIP, WINDOW = 256, 4 << 20
#: A byte that no UTF-8 text has: it stands between texts and sets the automaton back.
BREAK = 0xFF


class ByteDfa:
    """States are the nodes of the trie of sentinels (0: nothing begun) and, after them, one to three bytes that are to follow.

    A byte that begins or is a unit, and a continuation byte where none is due, count as one unit.  Each entry of the table is
    the next state with two bits: a unit begins, a sentinel ends.
    """

    def __init__(self, sentinels: Sequence[str]) -> None:
        words = [s.encode() for s in sentinels]
        if not all(words) or not all(w.isascii() for w in words):
            raise ValueError("sentinels are ASCII and not empty")
        for a in words:
            for b in words:
                if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                    raise ValueError("no sentinel may hold another one or begin with the end of one")
        prefixes = sorted({w[:k] for w in words for k in range(len(w))}, key=lambda p: (len(p), p))
        place = {p: i for i, p in enumerate(prefixes)}
        n = len(prefixes)
        table = np.zeros((n + 3, 256), np.uint16)
        for state in range(n + 3):
            for byte in range(256):
                if 0x80 <= byte < 0xC0:
                    due = state - n + 1 if state >= n else 0
                    table[state, byte] = (n + due - 2 if due > 1 else 0) << 2 | (not due)
                elif byte >= 0xC0:
                    due = 0 if byte == BREAK else 1 + (byte >= 0xE0) + (byte >= 0xF0)
                    table[state, byte] = (n + due - 1 if due else 0) << 2 | (byte != BREAK)
                else:
                    seen = (prefixes[state] if state < n else b"") + bytes([byte])
                    ended = any(seen.endswith(w) for w in words)
                    longest = next(p for p in reversed(prefixes) if seen.endswith(p))
                    table[state, byte] = (0 if ended else place[longest]) << 2 | ended << 1 | 1
        rows, self.classes = np.unique(table, axis=1, return_inverse=True)
        self.classes = self.classes.ravel().astype(np.uint8)
        self.width = rows.shape[1]
        #: next state times the number of classes, with the two bits below it
        self.table = ((rows >> 2).astype(np.int64) * self.width << 2 | (rows & 3)).ravel()
        self.warm = max(3, max(map(len, words)))

    def columns(self, data: np.ndarray, starts: np.ndarray, length: int):
        """The entries of all strips, column by column; strips reach from ``starts`` over ``length`` bytes of ``data``, which has
        ``warm`` breaks before its first byte and enough of them behind."""
        strips = np.ascontiguousarray(self.classes[sliding_window_view(data, length + self.warm)[starts]].T)
        entry = np.zeros(len(starts), np.int64)
        for k, column in enumerate(strips):
            entry = self.table[(entry >> 2) + column]
            if k >= self.warm:
                yield k - self.warm, entry


class Scan:
    """Counts of units and sentinels by strip of texts that stand one after another, each with a break behind."""

    def __init__(self, dfa: ByteDfa, texts: Sequence[bytes]) -> None:
        self.dfa = dfa
        self.begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        joined = b"\xff".join(texts)
        strips = len(joined) // STRIP + 2
        self.data = np.full(strips * STRIP + dfa.warm, BREAK, np.uint8)
        self.data[dfa.warm : dfa.warm + len(joined)] = np.frombuffer(joined, np.uint8)
        units, ends = [], []
        for low in range(0, strips, WINDOW // STRIP):
            starts = np.arange(low, min(strips, low + WINDOW // STRIP)) * STRIP
            unit, end = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            for _, entry in dfa.columns(self.data, starts, STRIP):
                unit += entry & 1
                end += (entry >> 1) & 1
            units.append(unit)
            ends.append(end)
        self.units, self.ends = np.concatenate(units), np.concatenate(ends)
        self.before = np.concatenate([[0], np.cumsum(self.units)])
        #: units before each text, and of all
        self.first = self.units_before(self.begin)

    def units_before(self, places: np.ndarray) -> np.ndarray:
        """Units that begin before each of some places in bytes, found within the strips of these."""
        strip = places // STRIP
        out, rest = self.before[strip].copy(), places - strip * STRIP
        for low in range(0, len(places), WINDOW // STRIP):
            part = slice(low, low + WINDOW // STRIP)
            for k, entry in self.dfa.columns(self.data, strip[part] * STRIP, STRIP):
                out[part] += (entry & 1) * (k < rest[part])
        return out

    def unit_places(self, wanted: np.ndarray) -> np.ndarray:
        """Places in bytes where the wanted units begin (counted from 0 over all texts)."""
        strip = np.searchsorted(self.before, wanted, side="right") - 1
        out = np.zeros(len(wanted), np.int64)
        for low in range(0, len(wanted), WINDOW // STRIP):
            part = slice(low, low + WINDOW // STRIP)
            left = wanted[part] - self.before[strip[part]] + 1
            for k, entry in self.dfa.columns(self.data, strip[part] * STRIP, STRIP):
                left = left - (entry & 1)
                out[part] += np.where((left == 0) & (entry & 1 == 1), strip[part] * STRIP + k, 0)
        return out

    def sentinel_ends(self) -> np.ndarray:
        """Places in bytes just behind every sentinel, ascending."""
        strips, found = np.flatnonzero(self.ends), []
        for low in range(0, len(strips), WINDOW // STRIP):
            part = strips[low : low + WINDOW // STRIP] * STRIP
            found += [part[np.flatnonzero(entry & 2)] + k + 1 for k, entry in self.dfa.columns(self.data, part, STRIP)]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _draws(keys) -> np.ndarray:
    """The first four 32-bit numbers of the digest of each key."""
    return np.array([struct.unpack(">4I", hashlib.sha256(b"1:" + (b"" if k is None else str(k).encode())).digest()[:16]) for k in keys], np.int64).reshape(-1, 4)


def transformed(dfa: ByteDfa, sentinels: Sequence[str], keys: list, texts: list[bytes], rate: int, spm_rate: int) -> tuple[list, list, list, list, list[bytes]]:
    """n, form, prefix and middle in units, and the output of each text."""
    pre, suf, mid = (s.encode() for s in sentinels)
    scan, h = Scan(dfa, texts), _draws(keys)
    n = np.diff(scan.first)
    ends = scan.sentinel_ends()
    marked = np.searchsorted(ends, scan.begin[1:]) > np.searchsorted(ends, scan.begin[:-1])
    plain = (n == 0) | marked | (h[:, 2] % 100 >= rate)
    spm = h[:, 3] % 100 < spm_rate
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    cut = np.flatnonzero(~plain)
    # a cut behind the last unit is where the text ends
    places = [np.where(at[cut] < n[cut], scan.unit_places(np.minimum(scan.first[:-1][cut] + at[cut], scan.first[1:][cut] - 1)), scan.begin[1:][cut] - 1) - scan.begin[:-1][cut] for at in (low, high)]
    outputs = list(texts)
    for i, x, y in zip(cut.tolist(), places[0].tolist(), places[1].tolist(), strict=True):
        t = texts[i]
        outputs[i] = b"".join((suf, t[y:], pre, t[:x], mid, t[x:y]) if spm[i] else (pre, t[:x], suf, t[y:], mid, t[x:y]))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist()
    none = lambda v: [None if p else x for p, x in zip(plain.tolist(), v.tolist(), strict=True)]
    return n.tolist(), form, none(low), none(high - low), outputs


def restored(dfa: ByteDfa, sentinels: Sequence[str], forms: list, outputs: list[bytes]) -> list[bytes]:
    """The texts that outputs and forms stand for."""
    held = [i for i, form in enumerate(forms) if form != "plain"]
    out = list(outputs)
    scan = Scan(dfa, [outputs[i] for i in held])
    ends = scan.sentinel_ends()
    if len(ends) != 3 * len(held):
        raise ValueError("an output that is not plain has three sentinels")
    pre, suf, mid = (len(s) for s in sentinels)
    for i, begin, (x, y, z) in zip(held, scan.begin[:-1].tolist(), (ends.reshape(-1, 3) - scan.begin[:-1, None]).tolist() if held else [], strict=True):
        o = outputs[i]
        out[i] = o[y : z - mid] + o[z:] + o[x : y - pre] if forms[i] == "spm" else o[x : y - suf] + o[z:] + o[y : z - mid]
    return out


_automata: dict[tuple[str, ...], ByteDfa] = {}


def _automaton(sentinels: Sequence[str]) -> ByteDfa:
    key = tuple(sentinels)
    if key not in _automata:
        _automata[key] = ByteDfa(key)
    return _automata[key]


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(batch.column(name).type) else pa.binary()
    return [x or b"" for x in batch.column(name).cast(kind).to_pylist()]


def _strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).view(pa.string())


def transform(docs: DataFrame, sentinels: Sequence[str] = SENTINELS, rate: int = 90, spm_rate: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts cut into prefix, middle and suffix and put in another order: key, n (code points), form (``plain``, ``psm``, ``spm``),
    prefix_chars, middle_chars (null if plain), output.

    ``rate`` of 100 texts are cut, ``spm_rate`` of 100 of these with the suffix first; a digest of the key decides.  Null texts are
    empty and, as texts that hold a sentinel, plain; a null key is hashed as no digits; rows, ties and repeats stay one to one; other
    columns aren't read; an empty table gives none.  Bytes that are no UTF-8 count one unit each.
    """
    _automaton(sentinels)  # refuses sentinels that overlap before any task runs
    kind = docs.schema[key].dataType.simpleString()

    def scan(batches):
        dfa = _automaton(sentinels)
        for batch in common.text_slices(batches):
            n, form, prefix, middle, outputs = transformed(dfa, sentinels, batch.column(0).to_pylist(), _texts(batch, "text"), rate, spm_rate)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _strings(outputs)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(docs[key], docs[text].alias("text")).mapInArrow(scan, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """All columns of ``rows``, with the text that ``output`` and ``form`` stand for as a further column ``restored``; null outputs are
    empty texts; a column of that name is replaced.  An output that is not plain and does not have three sentinels raises."""
    _automaton(sentinels)
    rows = rows.drop("restored")
    schema = StructType([*rows.schema.fields, StructField("restored", StringType())])

    def scan(batches):
        dfa = _automaton(sentinels)
        for batch in batches:
            texts = _texts(batch, "output")
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= common.SLICE_BYTES):
                    size, high = size + len(texts[high]), high + 1
                part = batch.slice(low, high - low)
                found = restored(dfa, sentinels, part.column("form").to_pylist(), texts[low:high])
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(found)], names=[*part.schema.names, "restored"])
                low = high

    return rows.mapInArrow(scan, schema)
