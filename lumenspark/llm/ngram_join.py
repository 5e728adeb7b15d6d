"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the components of its links.

1. Each text becomes its set of hashed shingles; equal sets are one class, known by a 128-bit digest.
2. Two sets of Jaccard similarity t share a shingle of both prefixes, the first n - ceil(t n) + 1 shingles in any order that
   all sets follow.  Here shingles with hashes in a low share of all values come first, the rarest of them before others, so
   a passage common to many documents links nobody by itself.  Only low shingles are sent on and counted; those that occur
   in one class need no more than their number.  Prefixes that share a shingle link classes into clusters no link leaves.
   Shingles that very many classes have are summed up in parts, so none meets its rows in one task.
3. Whole sets of clustered classes are brought together by cluster, large clusters as pairs of bounded blocks, and searched: each
   set is a query; its short inverted lists are merged by counting, the long ones probed by binary search (or merged, where
   most sets are candidates), and every candidate that reaches the required overlap is linked.
4. A task returns a star and the number of links of each class, a linked class counted with its copies; where clusters had
   blocks, stars are connected and numbers added over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected
from .shingles import shingle_sets

#: Low hashes, as a multiple of the share of shingles in a prefix: how much rarer shingles there are to choose from.
LOW = 2
#: Sets and shingles in a block of a cluster (a task holds two blocks); clustered classes that are broadcast (40 bytes each), and
#: ids (8 bytes each).
BLOCK, BLOCK_SHINGLES, BROADCAST_CLASSES, BROADCAST_IDS = 4000, 2_000_000, 300_000, 1_000_000
#: A shingle is common when it has so many of about so many sampled rows; about the quotient of the two can be common (8 bytes each).
COMMON, SAMPLED = 500, 2_000_000
#: Weight of a probe in the choice of the number of long lists; cost of a probe, in entries merged; entries merged at once.
PROBE, PROBES, MERGED = 0.01, 30, 4_000_000


def overlap_needed(n: int, m: int, percent: int) -> int:
    """The least intersection of sets of these sizes with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _class_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _merged(lists: list[np.ndarray], n: int) -> np.ndarray:
    """How often each of n places occurs in the lists, in parts of bounded size."""
    seen, part, held = np.zeros(n, np.int64), [], 0
    for entries in lists:
        part.append(entries)
        held += len(entries)
        if held > MERGED:
            seen += np.bincount(np.concatenate(part), minlength=n)
            part, held = [], 0
    if part:
        seen += np.bincount(np.concatenate(part), minlength=n)
    return seen


def linked(sets: list[np.ndarray], percent: int, side: list[int] | None = None, copies: list[int] | None = None, counted: bool = True) -> tuple[list[int], list[int]]:
    """The root of each set (the place of a set it is connected with) and its number of links, where a linked set counts as
    often as it has copies.  With ``side``, only sets of two sides are compared.  Not ``counted``: candidates that are connected
    already are not verified again, and numbers of links mean nothing."""
    total = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    sides = np.array(side if side else [0] * total, np.int64)
    weight = np.array(copies if copies else [1] * total, np.int64)
    order = np.lexsort((size, sides))
    first = int((sides == 0).sum()) if side else 0
    size, weight = size[order], weight[order]
    tokens = np.concatenate([sets[i] for i in order]) if total else np.zeros(0, np.int64)
    _, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.repeat(np.arange(total), size)
    # inverted lists, one after another by shingle, each by rank; shingles of one set alone are left out
    kept = counts[place] > 1
    place, rank = place[kept], rank[kept]
    by = np.argsort(place, kind="stable")
    entries, owner = rank[by], place[by]
    start = np.searchsorted(owner, np.arange(len(counts)))
    ends = np.searchsorted(rank, np.arange(total + 1))
    if side:
        key = owner * 2 + (entries >= first)
        upto = np.searchsorted(key, np.arange(len(counts)) * 2 + 1)[place]
    else:
        upto = np.empty(len(place), np.int64)
        upto[by] = np.arange(len(by))
    begin = start[place]
    parent, label, found = list(range(total)), np.arange(total), np.zeros(total, np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(first, total):
        low, high = begin[ends[i] : ends[i + 1]], upto[ends[i] : ends[i + 1]]
        some = high > low
        least = -(-percent * int(size[i]) // 100)
        if not size[i] or some.sum() < least:
            continue
        low, high = low[some], high[some]
        longest_last = np.argsort(high - low, kind="stable")
        low, high = low[longest_last], high[longest_last]
        skipped = min(least - 1, int(least / (PROBE * np.log2(high[-1] - low[-1] + 1) + 1)))
        cut = len(low) - skipped
        bound = first if side else i
        runs = [entries[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
        seen = _merged(runs[:cut], bound)
        other = np.flatnonzero(seen)
        if not counted:
            other = other[label[other] != label[i]]
        need = -(-percent * (size[i] + size[other]) // (100 + percent))
        able = (need <= np.minimum(size[i], size[other])) & (seen[other] + skipped >= need)
        other, need = other[able], need[able]
        if skipped and len(other):
            # probes where candidates are few for the length of the long lists, which are merged otherwise
            if len(other) * skipped * PROBES < int((high[cut:] - low[cut:]).sum()):
                hits = seen[other]
                for left, run in enumerate(reversed(runs[cut:]), 1):
                    hits += run[np.minimum(np.searchsorted(run, other), len(run) - 1)] == other
                    able = hits + skipped - left >= need
                    if not able.all():
                        other, need, hits = other[able], need[able], hits[able]
            else:
                hits = (seen + _merged(runs[cut:], bound))[other]
        else:
            hits = seen[other]
        other = other[hits >= need]
        if len(other):
            found[i] += weight[other].sum()
            found[other] += weight[i]
            roots = {root(x) for x in np.unique(label[other]).tolist()} | {root(i)}
            to = min(roots)
            for x in roots:
                parent[x] = to
            label[other] = label[i] = to
    roots, out = [0] * total, [0] * total
    for x, i in enumerate(order.tolist()):
        roots[i], out[i] = int(order[root(x)]), int(found[x])
    return roots, out


def links(sets: list[np.ndarray], percent: int, side: list[int] | None = None) -> list[int]:
    """The roots alone."""
    return linked(sets, percent, side)[0]


def _binary(values: list[bytes], times: list[int]) -> pa.Array:
    """Each 16-byte value as often as told."""
    data = np.repeat(np.frombuffer(b"".join(values), "V16"), times)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, 16 * len(data) + 1, 16, dtype=np.int32)), pa.py_buffer(data.tobytes())])


def _described(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, str]:
    """A row for each document (doc_id, tid: a hash of its text, n, cls, and ``sent``, its number of rows of the other kind),
    and rows (token, cls) of the low shingles of each class, or its prefix by hash where that is longer."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sent", pa.int64()), ("cls", pa.binary()), ("token", pa.int64()), ("tid", pa.int64())])
    bound = int(-(2**63) + 2**64 * min(1.0, LOW * (100 - percent) / 100)) if LOW * (100 - percent) < 100 else 2**63 - 1

    def scan(batches):
        seen: set[bytes] = set()
        for batch in common.text_slices(batches):
            sets = shingle_sets(batch.column("text"), words)
            classes = [_class_of(s) if len(s) else None for s in sets]
            sent, tokens, owners = [], [], []
            for s, c in zip(sets, classes, strict=True):
                n = len(s)
                sent.append(max(n - -(-percent * n // 100) + 1, int(np.searchsorted(s, bound))) if n else 0)
                if n and c not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(c)
                    tokens.append(s[: sent[-1]])
                    owners.append(c)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sent, pa.int64()), pa.array(classes, pa.binary()), none, batch.column("tid")], schema=schema)
            if tokens:
                flat = np.concatenate(tokens)
                none = pa.nulls(len(flat), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, _binary(owners, [len(t) for t in tokens]), pa.array(flat), none], schema=schema)

    return common.staged_at(docs.mapInArrow(scan, "doc_id long, n long, sent long, cls binary, token long, tid long"), "described", "zstd")


def _common(tokens: DataFrame, slim: DataFrame) -> list[int]:
    """Shingles that many classes of a bounded sample have.  They steer only how rows are dealt out: no link depends on them."""
    share = 1 + int(slim.agg(F.sum("sent")).first()[0] or 0) // SAMPLED
    sample = tokens.filter(F.pmod(F.xxhash64("cls"), F.lit(share)) == 0)
    return [r.token for r in sample.groupBy("token").count().filter(F.col("count") >= COMMON).select("token").collect()]


def _prefix_links(tokens: DataFrame, slim: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes whose links join the classes with a shingle of their prefixes in common.

    A shingle's classes are a star about the least of them, found by a window.  Common shingles come last in the order, their
    rows never meet in one task, and their classes are linked with a node for the shingle instead.
    """
    often = _common(tokens, slim)
    of_token = Window.partitionBy("token")
    rare, many = tokens.filter(~F.col("token").isin(often)), tokens.filter(F.col("token").isin(often))
    shared = rare.select("token", "cls", F.min("cls").over(of_token).alias("p"), F.max("cls").over(of_token).alias("q"), F.count(F.lit(1)).over(of_token).alias("df")).filter("p <> q")
    shared = shared.select("cls", "df", "token")
    if often:
        several = [r.token for r in many.groupBy("token").agg(F.min("cls").alias("p"), F.max("cls").alias("q")).filter("p <> q").select("token").collect()]
        shared = shared.unionByName(many.filter(F.col("token").isin(several)).select("cls", F.lit(2**62).alias("df"), "token"))
    lists, held = common.staged_at(shared.groupBy("cls").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("shared")), "shared", "zstd")
    sizes = slim.filter("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("sent").alias("sent"))
    # all shingles of one class alone come first in the order; what the prefix still needs are the rarest shared ones
    prefix = F.expr(f"n - (({percent} * n + 99) div 100) + 1")
    needed = lists.join(sizes, "cls").withColumn("need", (prefix - (F.col("sent") - F.size("shared"))).cast("int")).filter("need > 0")
    rows = common.staged(needed.select("cls", F.explode(F.slice("shared", F.lit(1), F.col("need"))).alias("x")).select("x.token", "cls"), "prefixes", "zstd")
    common.removed(tokens.sparkSession, held)
    stars = rows.filter(~F.col("token").isin(often)).select(F.col("cls").alias("a"), F.min("cls").over(of_token).alias("b"))
    # nodes of shingles follow all classes but for chance, and are no class themselves
    node = F.unhex(F.concat(F.lit("FF" * 8), F.lpad(F.hex("token"), 16, "0")))
    return stars.unionByName(rows.filter(F.col("token").isin(often)).select(F.col("cls").alias("a"), node.alias("b"))).filter("a <> b").distinct()


def _once(batches):
    """Rows of each class once, as far as a task remembers."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for c in batch.column("cls").to_pylist():
            keep.append(c not in seen)
            seen.add(c)
        if len(seen) > 200_000:
            seen.clear()
        yield batch if all(keep) else batch.filter(pa.array(keep))


def _searched(docs: DataFrame, reps: DataFrame, words: int, percent: int, counted: bool) -> DataFrame:
    """``cls``, ``root``, ``links`` and ``blocks`` from the search within clusters; ``reps``: rep, tid, cls, copies, cluster, blocks.

    Texts meet their class by doc_id and the hash of the text: an id alone may have very many texts.  Of repeated rows a task sends one on.
    """
    small = reps.count() <= BROADCAST_CLASSES
    reps = reps.withColumnRenamed("tid", "rep_tid")
    held = docs.join(F.broadcast(reps) if small else reps, docs["doc_id"].eqNullSafe(reps["rep"]) & (docs["tid"] == reps["rep_tid"])).select("cluster", "cls", "copies", "blocks", "text")
    held = held.mapInArrow(_once, held.schema)
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    held = held.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.withColumn("task", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    held = held.repartition("cluster", "task").sortWithinPartitions("cluster", "task")
    schema = pa.schema([("cls", pa.binary()), ("root", pa.binary()), ("links", pa.int64()), ("blocks", pa.int32())])

    def solved(task: int, rows: dict[bytes, tuple]):
        classes = list(rows)
        n = rows[classes[0]][2]
        # a task of two blocks compares sets of one with sets of the other, also where one of them is empty
        side = None if task // n == task % n else [int(rows[c][1] == task % n) for c in classes]
        roots, counts = linked([rows[c][0] for c in classes], percent, side, [rows[c][3] for c in classes], counted)
        return pa.RecordBatch.from_pydict({"cls": classes, "root": [classes[r] for r in roots], "links": counts, "blocks": [n] * len(classes)}, schema=schema)

    def scan(batches):
        now, rows = None, {}
        for batch in common.text_slices(batches):
            sets = shingle_sets(batch.column("text"), words)
            for cluster, c, m, n, b, t, s in zip(*(batch.column(x).to_pylist() for x in ("cluster", "cls", "copies", "blocks", "block", "task")), sets, strict=True):
                if (cluster, t) != now:
                    if rows:
                        yield solved(now[1], rows)
                    now, rows = (cluster, t), {}
                if _class_of(s) == c:  # for texts of equal ids and hashes
                    rows[c] = s, b, n, m
        if rows:
            yield solved(now[1], rows)

    return common.staged(held.mapInArrow(scan, "cls binary, root binary, links long, blocks int"), "searched")


def _grouped(docs: DataFrame, words: int, percent: int, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """A row for each document (doc_id, n, cls), and cls, least (doc_id), keeper (the least doc_id, nulls last, then class,
    of the group) and links of each class that is linked with others or has copies."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.xxhash64(docs["text"]).alias("tid"))
    described, held = _described(docs, words, percent)
    slim = common.staged(described.filter("token is null").select("doc_id", "tid", "n", "sent", "cls"), "documents")
    pairs = _prefix_links(described.filter("token is not null").select("token", "cls"), slim, percent)
    common.removed(docs.sparkSession, held)  # the rows of shingles are the largest table here, and the prefixes are staged
    clusters = connected(pairs)
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    clusters = clusters.select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    classes = slim.filter("n > 0").groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("rep"), F.first("n").alias("n"))
    classes = classes.select("cls", "copies", F.col("rep.doc_id").alias("rep"), F.col("rep.tid").alias("tid"), "n")
    classes = common.staged(classes.join(clusters, "cls", "left").filter("copies > 1 or cluster is not null"), "clustered")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = classes.filter("cluster is not null").groupBy("cluster").agg(blocks.alias("blocks")).filter("blocks > 1")
    clustered = classes.filter("cluster is not null").join(_few(large, BROADCAST_CLASSES), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    found = _searched(docs, clustered.drop("n"), words, percent, counted)
    whole = found.filter("blocks = 1").select("cls", "root")
    if found.filter("blocks > 1").limit(1).count():
        over = connected(found.filter("blocks > 1").select(F.col("cls").alias("a"), F.col("root").alias("b")))
        whole = whole.unionByName(over.select(F.col("node").alias("cls"), "root"))
    counted = found.groupBy("cls").agg(F.sum("links").alias("links"))
    rooted = classes.join(whole.filter("cls <> root"), "cls", "left").join(counted, "cls", "left")
    rooted = rooted.select("cls", "rep", F.coalesce("root", "cls").alias("group"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    keepers = rooted.groupBy("group").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("doc_id"), "cls")).alias("keeper"))
    joined = rooted.join(keepers, "group").select("cls", F.col("keeper.doc_id").alias("least"), F.struct("keeper.doc_id", "keeper.cls").alias("keeper"), "links")
    return slim.select("doc_id", "n", "cls"), common.staged(joined, "joined")


def _few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and n_links (other documents linked with it).

    Words are lower-cased (A-Z) runs without white space.  Null, empty and white texts have no shingles and are linked with
    nothing: component_id is doc_id, n_links 0.  A text of fewer words has one shingle.  Equal rows and repeated doc_ids stay one to
    one; a null doc_id is never the least unless all are null; an empty table gives no rows; other columns aren't read.
    """
    slim, joined = _grouped(docs, words, percent)
    out = slim.join(_few(joined.select("cls", "least", "links"), BROADCAST_CLASSES), "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def _with_class(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` and ``__cls``, the class of the text (null without words)."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__cls", T.BinaryType())])

    def scan(batches):
        for batch in common.text_slices(batches):
            classes = [_class_of(s) if len(s) else None for s in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(classes, pa.binary())], names=[*batch.schema.names, "__cls"])

    return docs.mapInArrow(scan, schema)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one row of each component stays: that with the least doc_id, then class.

    Rows are told apart by doc_id and class: of rows that share a doc_id (or have none) only those of one component are
    duplicates.  Rows without words are linked with nothing and all stay; an empty table gives an empty one.  Other columns are
    carried, whatever their names.  Texts shuffle only where the rows that go, or
    doc_ids that occur twice, are too many to broadcast; only texts of the latter are read for their classes.
    """
    columns = docs.columns
    docs = docs.select(*[docs[c].alias(c if c in ("doc_id", "text") else f"__c{i}") for i, c in enumerate(columns)])
    slim, joined = _grouped(docs, words, percent, counted=False)
    blank = F.length(F.translate(F.coalesce(docs["text"], F.lit("")), common.WHITE_CHARS, "")) == 0
    full = slim.filter("n > 0")
    rows = full.join(_few(joined.select("cls", "keeper"), BROADCAST_CLASSES), "cls", "left")
    is_keeper = F.col("keeper").isNull() | (F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.cls") == F.col("cls")))
    gone = common.staged(rows.filter(~is_keeper).select(F.col("doc_id").alias("__id"), F.col("cls").alias("__gone")).distinct(), "gone")
    # a null doc_id names no document, even where there is one of it
    twice = full.groupBy(F.col("doc_id").alias("__id")).count().filter("count > 1 or __id is null").select("__id")
    twice = common.staged(twice, "twice")
    kept = docs.filter(~blank).join(_few(gone.select("__id").distinct(), BROADCAST_IDS), docs["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left_anti")
    if twice.limit(1).count():
        same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id"))
        few = _few(twice, BROADCAST_IDS)
        kept = kept.join(few, same, "left_anti")
        shared = _with_class(docs.filter(~blank).join(few, same, "left_semi"), words)
        lost = _few(gone.join(twice.withColumnRenamed("__id", "__twice"), F.col("__id").eqNullSafe(F.col("__twice")), "left_semi"), BROADCAST_CLASSES)
        shared = shared.join(lost, (F.col("__cls") == F.col("__gone")) & shared["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left_anti")
        kept = kept.unionByName(shared.dropDuplicates(["doc_id", "__cls"]).drop("__cls"))
    return kept.unionByName(docs.filter(blank)).toDF(*columns)
