"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is set only where nothing is configured, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        jsc = spark.sparkContext._jsc.sc()
        found = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
    if found is None:
        found = tempfile.mkdtemp(prefix="logloom-ckpt-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small tables and iterative plans."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back.

    Used where a table is large or read by several later jobs: files survive
    executors, and the reader prunes columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stash_by(df: DataFrame, name: str) -> DataFrame:
    """A stash dealt out by a column into as many buckets as there are shuffle partitions: joins on it need no exchange of the table."""
    spark = df.sparkSession
    table = f"stash_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{table.replace('_', '-')}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), name).sortBy(name).saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  resolved before the catalog forgets it; the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a stash that nothing reads any more."""
    jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("stash-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop shuffle files of plans that are gone."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of the input has it, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


MANY = 10_000  # colliding texts that an expression may name


def text_ids(docs: DataFrame) -> Column:
    """A 64-bit number of each text, another one for every other MD5 digest.

    Digests whose hashes meet are found by one aggregate and hashed once more; of n
    texts about n * n / 2**65 are among them, 68 of 5 * 10**10.
    """
    digest = F.md5(F.col("text").cast("binary"))
    out, k = F.xxhash64(digest, F.length("text")), 0
    while True:
        seen = docs.where("text IS NOT NULL").select(out.alias("id"), digest.alias("d"))
        met = seen.groupBy("id").agg(F.min("d").alias("x"), F.max("d").alias("y")).where("x <> y").limit(MANY).collect()
        if not met:
            return out
        if len(met) == MANY:
            raise ValueError("too many texts with equal hashes")
        k += 1
        out = F.when(digest.isin([r["y"] for r in met]), F.xxhash64(digest, F.length("text"), F.lit(k))).otherwise(out)


def partitions(spark: SparkSession) -> int:
    """Buckets follow the session's shuffle partitions, which follow the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
