"""Mixing sources to target weights (native DataFrame operations only).

Efraimidis-Spirakis sampling: each document draws a key ``-ln(u) / w`` from a
hash of its id and its quality weight ``w``.  A source whose target is T words
of its S first gives ``floor(T / S)`` complete epochs, then documents in key
order until the running sum of their sizes meets the rest of the budget.

No row of a source ever meets all others in one task: a histogram of key bins
per source finds the bin where the budget ends, and only that bin's distinct
keys are put in order.  Every document's share is then a function of its own
row and of one small row per source.

Defined results for odd input:
* null text has size 0 and takes nothing; a null source is a source of its own,
  which comes last; a null id hashes like the empty string;
* rows whose keys tie (repeated rows) share what is left in proportion to size;
* an empty table gives an empty result; a source of size 0 has target 0;
* columns named like one of the four added ones (ADDED), whatever the case, are
  replaced by it; columns of any other name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, table

WORDS = r"[^\x20\x09-\x0D]+"
NOT_LETTER = r"[^\p{L}\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BINS = 4096
ADDED = ("size", "source_size", "target", "taken")
SMALL_SOURCES = 100_000  # rows of the per-source table that may be broadcast


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Share of characters that are letters or white space, 0.05 at least."""
    kept = F.length(F.regexp_replace(text, NOT_LETTER, "")).cast("double")
    return F.coalesce(F.greatest(F.lit(0.05), kept / F.nullif(F.length(text), F.lit(0))), F.lit(0.05))


def key_of(doc_id: Column, weight: Column) -> Column:
    """The exponential key; u lies strictly between 0 and 1."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.ln(u) / weight


def _bin(key: Column, bins: int) -> Column:
    """Rises with the key, about evenly filled where weights are near 1."""
    return F.least(F.floor((F.lit(1.0) - F.exp(-key)) * bins), F.lit(bins - 1)).cast("int")


def _ranked(totals: DataFrame) -> DataFrame:
    """Adds the source's place in code point order, nulls last, without one task for all."""
    laid = cut(
        totals.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("pid", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # one row per partition, so the window is as small as the partition count
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("pid").count().select("pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("off"))
    return laid.join(F.broadcast(offsets), "pid").withColumn("rank", F.col("off") + F.col("at")).drop("pid", "at", "off")


def targets(totals: DataFrame, rate: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> + target: shares by weight, filled up to the cap.

    The level is raised until no source is above its cap; each step is one small
    aggregate, and the level only rises, so few steps are needed.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = cut(_ranked(totals).withColumn("w", w))
    whole = t.agg(F.sum("source_size")).first()[0] or 0
    total, level, last = rate * whole, 0.0, None
    while True:
        full = F.col("w") * F.lit(level) >= F.col("source_size") * cap
        if last is None:
            full = F.col("source_size") == 0
        row = t.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("w")))).first()
        now = (row[0] or 0, row[1] or 0.0)
        if now == last or not now[1]:
            break
        level, last = (total - now[0]) / now[1], now
    capped = (F.col("source_size") * cap).cast("double")
    target = F.when(F.col("source_size") == 0, 0.0).when(F.col("w") * F.lit(level) >= capped, capped).otherwise(F.col("w") * F.lit(level))
    if last is None or not now[1]:
        target = F.least(capped, F.lit(total) * F.col("source_size") / F.lit(max(1, whole)))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def cutoffs(sized: DataFrame, rate: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS, bins: int = BINS) -> DataFrame:
    """From (source, size, key): one row per source with target, epochs and where the fraction ends."""
    sized = sized.select("source", "size", "key")
    hist = cut(sized.withColumn("bin", _bin(F.col("key"), bins)).groupBy("source", "bin").agg(F.sum("size").alias("words")))
    goal = targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), rate, cap, weights)
    want = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = cut(goal.withColumn("epochs", epochs).withColumn("rest", want - F.col("epochs") * F.col("source_size")))

    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = hist.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    goal2 = goal.select(F.col("source").alias("s2"), "rest")
    edge = cut(
        before.join(goal2, F.col("source").eqNullSafe(F.col("s2")))
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        .select(F.col("s2"), F.col("bin").alias("b2"), (F.col("rest") - F.col("before")).alias("left"))
    )  # at most one bin a source
    small = goal.count() <= SMALL_SOURCES
    side = F.broadcast(edge) if small else edge
    keys = (
        sized.join(side, F.col("source").eqNullSafe(F.col("s2")) & (_bin(F.col("key"), bins) == F.col("b2")))
        .groupBy(F.col("s2"), "key")
        .agg(F.sum("size").alias("tied"), F.first("left").alias("left"))
    )
    upto = Window.partitionBy("s2").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    end = (
        keys.withColumn("prior", F.coalesce(F.sum("tied").over(upto), F.lit(0)))
        .where((F.col("prior") < F.col("left")) & (F.col("prior") + F.col("tied") >= F.col("left")))
        .select("s2", F.col("key").alias("cut_key"), "tied", (F.col("left") - F.col("prior")).alias("share"))
    )
    out = goal.join(end, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2", "rest")
    return cut(out.withColumn("few", F.lit(small)))


def mix(sized: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to rows that carry source, size and key.

    ``taken`` counts the words the mix takes of a document, repeats counted; the
    document on the edge of the budget gives its leading words only.
    """
    few = ends.select("few").first()
    ends = ends.drop("few").withColumnRenamed("source", "s3")
    side = F.broadcast(ends) if few is None or few[0] else ends
    part = (
        F.when(F.col("key") < F.col("cut_key"), F.col("size"))
        .when(F.col("key") == F.col("cut_key"), F.expr("size * share div tied"))
        .otherwise(F.lit(0))
    )
    out = sized.join(side, F.col("source").eqNullSafe(F.col("s3")))
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).drop("s3", "epochs", "cut_key", "share", "tied")


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """source, size and key of each row, and the kept columns in one."""
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in ADDED]
    row = [F.struct(*kept).alias("row")] if kept else []
    return docs.select(*row, "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), quality_of(F.col("text"))).alias("key"))


def mix_documents(docs: DataFrame, keep: list[str] | None = None, rate: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Mix of all documents: the kept columns, size, source_size, target and taken."""
    if keep is not None:
        slim = cut(sized(docs, keep))
        return mix(slim, cutoffs(slim, rate, cap, weights)).select("row.*", *ADDED)
    ends = cutoffs(cut(sized(docs, [])), rate, cap, weights)
    return mix(sized(docs, docs.columns), ends).select("row.*", *ADDED)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(greatest(0.05::DOUBLE, length(regexp_replace(text, '[^\p{L}\x20\x09-\x0D]+', '', 'g'))::DOUBLE / nullif(length(text), 0)::DOUBLE), 0.05::DOUBLE) AS w,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), k AS (SELECT doc_id, source, size, -ln(u) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM k GROUP BY source),
s1 AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS sw, 2 * source_size AS most FROM s),
o AS (SELECT *, most::DOUBLE / sw AS ratio FROM s1),
p AS (SELECT *, coalesce(sum(most) OVER (ORDER BY ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
             sum(sw) OVER (ORDER BY ratio, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT::DOUBLE) AS total FROM o),
l AS (SELECT (total - capped::DOUBLE) / open AS level FROM p WHERE (total - capped::DOUBLE) / open < ratio ORDER BY ratio, r LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN sw * level >= most::DOUBLE THEN most::DOUBLE ELSE sw * level END AS target FROM o, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
f AS (SELECT *, round(target)::BIGINT - epochs * source_size AS rest FROM e),
g AS (SELECT source, key, sum(size)::BIGINT AS tied FROM k GROUP BY ALL),
h AS (SELECT source, key, tied, coalesce(sum(tied) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM g)
SELECT k.doc_id, k.size, f.source_size, f.target,
       (f.epochs * k.size + CASE WHEN h.tied = 0 THEN 0 ELSE k.size * greatest(0, least(h.tied, f.rest - h.prior)) // h.tied END)::BIGINT AS taken
FROM k JOIN h ON h.source IS NOT DISTINCT FROM k.source AND h.key = k.key
JOIN f ON f.source IS NOT DISTINCT FROM k.source
"""
