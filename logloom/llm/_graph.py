"""Connected components: forests of bounded parts of the edges, then large-star and small-star joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from ._spark import cut

PART = 1_000_000  # edges that one task joins into a forest


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a part's edges with the least node of its tree there."""
    up: dict = {}
    kind = None

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = [x for x in up if root(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): comp is the least node of the component.

    First, tasks of at most PART edges each find their own trees; where there is
    only one such part, that is the result.
    Each half step is an aggregate with map-side minimum and a join on nodes; no
    neighbourhood is gathered into one row, and nothing but a checksum is collected.
    The steps go on until the checksum stands still, however many that takes.
    """
    ship(edges.sparkSession)
    e = cut(edges.where("a <> b").select("a", "b"))
    parts = max(1, -(-e.count() // PART))
    e = cut(e.coalesce(parts).mapInArrow(_forest, e.schema))
    seen = None
    while parts > 1:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge now points down; each node links its smaller neighbours to the least of them
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(low, "a")
        e = cut(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(joined.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
