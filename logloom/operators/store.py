"""The raw store: dense ids, digests, an integrity chain, verification and attestation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = b"logloom chain genesis"
EVERY = 4096


def genesis(store_id: str) -> bytes:
    return hashlib.sha256(GENESIS + store_id.encode()).digest()


def digest(data: Column) -> Column:
    """SHA-256 of bytes, as bytes."""
    return F.unhex(F.sha2(data, 256))


def dense_ids(events: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """raw_id from ``first`` without gaps in the given order.

    A range partitioning puts the rows in order; each partition's count gives its
    offset, so that no task sees more than its own rows.
    """
    laid = events.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = laid.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    laid = laid.checkpoint() if events.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else laid.persist()
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = laid.groupBy("__p").count().select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
    return laid.join(F.broadcast(offsets), "__p").withColumn("raw_id", F.col("__o") + F.col("__i") + F.lit(first)).drop("__p", "__i", "__o")


def chain(records: DataFrame, start: Column | bytes, length: int = EVERY) -> DataFrame:
    """(raw_id, sha256, chain): each link is the hash of the last link and the record's digest.

    The fold is sequential by nature: a chunk of ``length`` records is folded in
    one row and its last link starts the next chunk, on the driver.
    """
    head = start if isinstance(start, bytes) else None
    low, high = records.agg(F.min("raw_id"), F.max("raw_id")).first()
    out = None
    while low is not None and low <= high:
        part = records.where(F.col("raw_id").between(low, low + length - 1)).select("raw_id", "sha256")
        row = part.agg(F.sort_array(F.collect_list(F.struct("raw_id", "sha256"))).alias("r"))
        seed = F.array(F.lit(head))
        folded = row.select("r", F.aggregate("r", seed, lambda acc, x: F.concat(acc, F.array(F.unhex(F.sha2(F.concat(F.element_at(acc, -1), x["sha256"]), 256))))).alias("c"))
        done = folded.select(F.explode(F.arrays_zip("r", F.slice("c", 2, length).alias("l"))).alias("z")).select("z.r.raw_id", "z.r.sha256", F.col("z.l").alias("chain")).collect()
        piece = records.sparkSession.createDataFrame(done, "raw_id long, sha256 binary, chain binary")
        out = piece if out is None else out.unionByName(piece)
        head = bytes(done[-1]["chain"])
        low += length
    return out


def verify(records: DataFrame, start: bytes, data: str = "bytes") -> DataFrame:
    """raw_id and fault (digest or chain) of every record that does not hold; parallel but for the order.

    Each link is checked against the stored link before it, so one break is told once.
    """
    w = Window.orderBy("raw_id")
    last = F.coalesce(F.lag("chain").over(w), F.lit(start))
    own = F.sha2(F.col(data), 256) == F.lower(F.hex("sha256"))
    link = F.sha2(F.concat(last, F.col("sha256")), 256) == F.lower(F.hex("chain"))
    fault = F.when(~own, "digest").when(~link, "chain")
    return records.select("raw_id", fault.alias("fault")).where("fault IS NOT NULL")


def attest(records: DataFrame, every: int = EVERY) -> DataFrame:
    """Checkpoints: every ``every``-th record and the last."""
    last = records.agg(F.max("raw_id").alias("last"))
    return records.crossJoin(F.broadcast(last)).where((F.col("raw_id") % every == 0) | (F.col("raw_id") == F.col("last"))).drop("last")


def verify_against(records: DataFrame, document: DataFrame) -> DataFrame:
    """Checkpoints of a document that the records do not bear out."""
    mine = records.select("raw_id", F.col("chain").alias("mine"))
    return document.join(mine, "raw_id", "left").where(~F.col("chain").eqNullSafe(F.col("mine"))).select("raw_id")


def resume_offsets(records: DataFrame, data: str = "bytes") -> DataFrame:
    """Bytes stored of each source."""
    return records.groupBy("source").agg(F.sum(F.octet_length(data)).alias("bytes_stored"), F.count("*").alias("events"))
