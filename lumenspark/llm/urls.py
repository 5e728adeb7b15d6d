"""URL filter over a sorted digest array.

The rules (host plus path prefix) are stored in one file: 64-bit xxhash keys in ascending order, then offsets, verdicts and
the full rule strings.  Workers map the file into memory, form every rule string that could fit a url (each suffix of the
host at a dot, with each path length that rules have), look all of a batch up by one vectorised binary search, and compare
the stored string of every equal key with the candidate, so a collision of keys never decides.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Format name and version of the file.
_MAGIC = b"URLKEYS1"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one, or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_file(rules: list[tuple[str, str]]) -> bytes:
    """``rules``: (``host/path``, ``allow`` or ``block``); of equal rules the last counts."""
    own = {rule.partition("/")[0].lower() + rule[len(rule.partition("/")[0]) :]: verdict for rule, verdict in rules}
    rows = sorted((xxhash.xxh64_intdigest(rule), rule.encode(), verdict == "block") for rule, verdict in own.items())
    keys, texts = np.array([k for k, _, _ in rows], "<u8"), [t for _, t, _ in rows]
    offsets = np.cumsum([0, *map(len, texts)]).astype("<u8")
    lengths = sorted({len(rule) - rule.index("/") for rule in own})  # in code points, of the paths
    head = struct.pack("<8sQQ", _MAGIC, len(rows), len(lengths)) + np.array(lengths, "<u8").tobytes()
    return head + keys.tobytes() + offsets.tobytes() + b"".join(texts) + bytes(block for _, _, block in rows)


class RuleFile:
    def __init__(self, path: str) -> None:
        data = self.data = np.memmap(path, np.uint8, "r")
        magic, n, k = struct.unpack_from("<8sQQ", data)
        if magic != _MAGIC:
            raise ValueError("not a rule file")
        self.lengths = np.frombuffer(data, "<u8", k, 24).tolist()
        self.keys = np.frombuffer(data, "<u8", n, 24 + 8 * k)
        self.offsets = np.frombuffer(data, "<u8", n + 1, 24 + 8 * (k + n))
        self.texts = 24 + 8 * (k + 2 * n + 1)
        self.blocks = np.frombuffer(data, np.uint8, n, self.texts + int(self.offsets[-1]))

    def text(self, i: int) -> bytes:
        return self.data[self.texts + int(self.offsets[i]) : self.texts + int(self.offsets[i + 1])].tobytes()

    def longest(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """For each url the longest rule that fits and whether it blocks."""
        owner, rules = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            labels = host.split(".")
            ends = [".".join(labels[k:]) for k in range(len(labels))]
            for n in self.lengths:
                if n <= len(path):
                    rules += [(end + path[:n]).encode() for end in ends]
                    owner += [i] * len(ends)
        best: list[tuple[str, bool] | None] = [None] * len(hosts)
        if not rules or not len(self.keys):
            return best
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, rules), np.uint64, len(rules))
        low, high = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        for j in np.flatnonzero(low < high).tolist():
            for at in range(low[j], high[j]):
                if self.text(at) == rules[j] and (best[owner[j]] is None or len(best[owner[j]][0]) < len(rules[j].decode())):
                    best[owner[j]] = rules[j].decode(), bool(self.blocks[at])
        return best


_files: dict[str, RuleFile] = {}


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (the longest that fits, else null) and verdict (its own, else ``default``) of each url.

    Null, empty and scheme-less urls have empty host and path and no rule; no two rules that fit a url are of one length (one
    host, one path); rows stay one to one, repeated ones too; an empty table gives no rows; other columns aren't read.
    The file goes to executors through Spark's file distribution: each has one local copy, whose pages its workers share.
    """
    spark = pages.sparkSession
    data = rule_file(rules)
    name = f"rules-{hashlib.sha256(data).hexdigest()[:32]}.bin"
    if name not in {Path(f).name for f in spark.sparkContext.listFiles}:
        path = Path(tempfile.mkdtemp(prefix="rules-")) / name
        path.write_bytes(data)
        spark.sparkContext.addFile(str(path))
    kind = pages.schema[key].dataType.simpleString()

    def scan(batches):
        if name not in _files:
            _files[name] = RuleFile(SparkFiles.get(name))
        for batch in batches:
            found = _files[name].longest(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([("block" if f[1] else "allow") if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[key, "host", "path", "rule", "verdict"])

    return pages.select(pages[key], host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path")).mapInArrow(scan, f"`{key}` {kind}, host string, path string, rule string, verdict string")
