"""Quality rules with host verdicts, in DataFrame operations.

Every document gets its own counts and rule failures.  Failures are summed by host (for documents: their source), the rates
of the hosts give a beta prior by its moments, and each host's rate is shrunk towards it.  A host whose posterior is almost surely above
the prior's mean is suspect, one where most documents fail is bad; the verdict is joined back.  A document goes if it fails a rule,
if its host is bad, or if it is doubtful (fails the sharper limits below) and its host suspect: on other hosts it stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Base rules: fewer words, or a larger percentage of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rules of the host statistics, besides: percentages of symbols among characters of words, and of repeated lines.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 50
#: Percentages above which a document is doubtful: symbols, repeated lines, words in repeated windows.
DOUBTFUL_SYMBOLS, DOUBTFUL_DUP_LINES, DOUBTFUL_REPEATED = 2, 35, 25
#: A host is suspect when its rate exceeds the prior's mean with a chance above 0.95 under its beta posterior (by the normal approximation: its
#: shrunk rate is more than so many standard deviations above), bad when its shrunk rate is above the second figure.
SUSPECT, BAD_RATE = 1.6448536269514722, 0.5
#: Suspect and bad hosts up to this number are broadcast (below 20 MB); more are joined by shuffle, the documents' side salted.
BROADCAST_HOSTS, SALT = 100_000, 32
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


#: Bits of a place in a text within a packed hash; longer texts are sorted by whole hashes.
PLACE = 24


def counted(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep``, the five counts and n_lines (lines with a word), in steps so that no array is computed twice.

    Repeated windows: windows of three words are hashed to 64 bits.  Only where two hashes of a text agree, hashes and
    places are packed into integers and sorted; windows whose packed hash has an equal neighbour are compared by whole
    hashes and words.  Texts never leave their row.
    """
    carried = [f"__k{i}" for i in range(len(keep))]
    step = docs.select(*[k.alias(c) for k, c in zip(keep, carried, strict=True)], F.coalesce(text, F.lit("")).alias("__t"))
    with_word = F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{common.WHITE}]"))
    step = step.select(*carried, "__t", F.array_remove(F.split("__t", f"[{common.WHITE}]+"), "").alias("__w"), with_word.alias("__lines"))
    step = step.select(
        *carried, "__w",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", common.WHITE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.expr("slice(transform(__w, (x, i) -> xxhash64(x, get(__w, i + 1), get(__w, i + 2))), 1, greatest(size(__w) - 2, 0))").alias("__h"),
    )
    counts = [*COUNTS[:4], "n_lines"]
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    step = step.select(*carried, "__w", *counts, F.when(twice, F.col("__h")).alias("__h"))
    mask = -(1 << PLACE)
    step = step.select(*carried, "__w", *counts, "__h", F.when(F.size("__h") < 1 << PLACE, F.expr(f"sort_array(transform(__h, (h, i) -> (h & {mask}L) | i))")).alias("__p"))
    near = f"filter(__p, (x, k) -> shiftright(x ^ get(__p, k + 1), {PLACE}) = 0 or shiftright(x ^ get(__p, k - 1), {PLACE}) = 0)"
    places = f"transform({near}, x -> cast(x & {(1 << PLACE) - 1}L as int))"
    step = step.select(*carried, "__w", *counts, "__h", F.expr(f"if(__p is null and __h is not null, sequence(0, size(__h) - 1), {places})").alias("__c"))
    step = step.select(*carried, "__w", *counts, F.expr("array_sort(transform(__c, i -> struct(__h[i] as h, i as i)))").alias("__s"))
    same = "(__s[k].h = __s[k + {0}].h and __w[__s[k].i] = __w[__s[k + {0}].i] and __w[__s[k].i + 1] = __w[__s[k + {0}].i + 1] and __w[__s[k].i + 2] = __w[__s[k + {0}].i + 2])"
    step = step.select(*carried, *counts, F.expr(f"if(size(__s) > 0, transform(filter(sequence(0, size(__s) - 1), k -> (k > 0 and {same.format(-1)}) or (k < size(__s) - 1 and {same.format(1)})), k -> __s[k].i), null)").alias("__r"))
    covered = "size(array_distinct(flatten(transform(__r, i -> array(i, i + 1, i + 2)))))"
    return step.select(*carried, *counts, F.expr(f"if(__r is null, 0L, cast({covered} as long))").alias("n_repeat_words")).select(*carried, *COUNTS, "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rules_failed(lines: Column) -> Column:
    """Base rules, and those of the host statistics; ``lines`` is the number of lines with a word."""
    return base_failed() | (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * lines)


def doubtful(lines: Column) -> Column:
    return (
        (100 * F.col("n_symbols") > DOUBTFUL_SYMBOLS * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > DOUBTFUL_DUP_LINES * lines)
        | (100 * F.col("n_repeat_words") > DOUBTFUL_REPEATED * F.col("n_words"))
    )


def host_table(scored: DataFrame, host: str = "host", failed: str = "failed") -> DataFrame:
    """Documents, failures, shrunk failure rate and verdict (good, suspect, bad) of each host; partial sums are formed before the
    shuffle; an empty table gives no hosts.

    The prior: with m the rate over all documents and v the weighted variance of the hosts' rates less what chance gives,
    its weight is m (1 - m) / v - 1 within bounds; without spread the weight is the upper bound.
    """
    hosts = common.staged(scored.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("k")), "hosts")
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    n, k = sums["n"] or 0, sums["k"] or 0
    m = k / n if n else 0.0
    chance = m * (1 - m)
    spread = (sums["kk"] / n - m * m) - chance * sums["hosts"] / n if n else 0.0
    weight = min(MOST_WEIGHT, max(LEAST_WEIGHT, chance / spread - 1)) if spread > 0 else MOST_WEIGHT
    rate = (F.col("k") + m * weight) / (F.col("n") + weight)
    above = rate - m > SUSPECT * F.sqrt(rate * (1.0 - rate) / (F.col("n") + weight + 1.0))
    verdict = F.when(rate > BAD_RATE, "bad").when(above, "suspect").otherwise("good")
    return hosts.select(host, "n", "k", rate.alias("rate"), verdict.alias("verdict"))


def judged(scored: DataFrame, hosts: DataFrame, host: str = "host", failed: str = "failed") -> DataFrame:
    """``scored`` with ``host_verdict`` and ``kept``; hosts that aren't among the suspect and bad ones are good."""
    known = hosts.filter("verdict <> 'good'").select(F.col(host).alias("__host"), F.col("verdict").alias("__verdict"))
    if known.count() <= BROADCAST_HOSTS:
        joined = scored.join(F.broadcast(known), F.col(host).eqNullSafe(F.col("__host")), "left")
    else:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")
        known = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = scored.withColumn("__s", salt).join(known, F.col(host).eqNullSafe(F.col("__host")) & (F.col("__s") == F.col("__salt")), "left").drop("__salt", "__s")
    joined = joined.withColumn("host_verdict", F.coalesce("__verdict", F.lit("good"))).drop("__host", "__verdict")
    gone = F.col(failed) | (F.col("host_verdict") == "bad") | (F.col("doubtful") & (F.col("host_verdict") == "suspect"))
    return joined.withColumn("kept", ~gone)


def _scored(docs: DataFrame, keep: list[Column], host: Column, text: Column) -> DataFrame:
    carried = [f"__c{i}" for i in range(len(keep))]
    named = counted(docs, text, [*keep, F.coalesce(host, F.lit(""))]).toDF(*carried, "host", *COUNTS, "n_lines")
    return named.withColumn("base_failed", base_failed()).withColumn("failed", rules_failed(F.col("n_lines"))).withColumn("doubtful", doubtful(F.col("n_lines"))).drop("n_lines")


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, the counts, base_failed, kept, rules_failed, doubtful, host and the host's verdict, for every document.

    A null text has no words and fails; null and empty hosts are one host; rows stay one to one; repeated rows count each;
    an empty table gives no rows; other columns aren't read.  Counts (without texts) are stored once in the shared folder.
    """
    scored = common.staged(_scored(docs, [docs[key]], docs[host], docs[text]), "quality").withColumnRenamed("__c0", key)
    out = judged(scored, host_table(scored))
    return out.select(key, *COUNTS, "base_failed", "kept", F.col("failed").alias("rules_failed"), "doubtful", "host", "host_verdict")


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with their columns.  Texts never shuffle while the bad hosts fit a broadcast.

    Documents are stored once in the shared folder with host and failure, so counts are computed once: the host statistics
    read two columns of that table, and the verdict filters its scan.  Null texts have no words and go; null and empty hosts are
    one host; repeated rows are judged one by one; an empty table gives an empty one.
    """
    columns = docs.columns
    carried = [f"__c{i}" for i in range(len(columns))]
    scored = common.staged(_scored(docs, [docs[c] for c in columns], docs[host], docs[text]).select(*carried, "host", "failed", "doubtful"), "quality-documents", "zstd")
    out = judged(scored, host_table(scored.select("host", "failed")))
    return out.filter("kept").select(*[F.col(c).alias(name) for c, name in zip(carried, columns, strict=True)])
