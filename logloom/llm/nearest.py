"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Equal vectors are one node.  Nodes live in buckets; a bucket's ids, vectors and
neighbour lists are one row of packed arrays.  The graph starts from groups of
random-projection signs and improves by rounds of neighbours of neighbours: every
node's list and reverse list meet at the node, all pairs there are measured, and
each member is offered its best partners of that meeting.  A vector goes to a
bucket once a round, however many lists there hold it.  Only pairs with a new
member are measured, and rounds end when few lists change.

Queries search greedily: a beam of nodes, of which the nearest unexpanded ones are
expanded hop by hop, starting from the query's own node.  Distances of the result
are worked out anew in double precision.

Reverse lists longer than REVERSE are sampled within a round; this only shapes
the index.  Recall is measured against brute force in the tests.

Defined results: null and zero vectors and those with null or non-finite parts
take no part, nor do vectors of another length than most have; rows of one vec_id
and equal vectors count once; a query's own row is never its answer, equal
vectors of other rows are, at distance 0; ties go to the smaller vec_id; fewer
candidates than k give them all; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._ship import ship
from ._spark import free_shuffles, partitions, stash, table
from ._text import U, mix

DEGREE = 48
REVERSE = 48
OFFERS = 6  # partners offered to each member of a meeting
ROUNDS = 8
TABLES = 4
LEAF = 512
BEAM = 96
EXPAND = 24
HOPS = 4
QUIET = 0.02
STATE = "bucket int, ids binary, vecs binary, nb binary, nd binary, nw binary"
MESSAGE = "bucket int, a binary, b binary, x binary"


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(ids.astype(np.int64).view(U) + U(0x5851F42D4C957F2D)) >> U(33)) % U(buckets)).astype(np.int32)


def _split(dest: np.ndarray, *cols: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
    order = np.argsort(dest, kind="stable")
    d = dest[order]
    edge = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(d))
    return [(int(d[s]), [c[order[s:e]] for c in cols]) for s, e in zip(edge, ends, strict=True)]


def _join(series: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in series if x), kind)


class Bucket:
    def __init__(self, row: pd.Series, dim: int, degree: int):
        self.ids = np.frombuffer(row.ids, "<i8")
        n = len(self.ids)
        self.vecs = np.frombuffer(row.vecs, "<f4").reshape(n, dim)
        self.nb = np.frombuffer(row.nb, "<i8").reshape(n, degree)
        self.nd = np.frombuffer(row.nd, "<f4").reshape(n, degree)
        self.nw = np.frombuffer(row.nw, "u1").reshape(n, degree)

    def at(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)


def _rows(rows: list[tuple], names: str = MESSAGE) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in names.split(", ")])


def _offers(u: np.ndarray, v: np.ndarray, d: np.ndarray, degree: int, buckets: int) -> list[tuple]:
    """The best distinct offers of each node, by bucket."""
    order = np.lexsort((v, d, u))
    u, v, d = u[order], v[order], d[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])  # one pair has one distance
    u, v, d = u[new], v[new], d[new]
    head = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(head, np.diff(np.append(head, len(u))))
    keep = rank < degree
    return [(b, c[0].tobytes(), c[1].tobytes(), c[2].tobytes()) for b, c in _split(bucket_of(u[keep], buckets), u[keep], v[keep], d[keep])]


def _best(vecs: np.ndarray, ids: np.ndarray, fresh: np.ndarray | None, offers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each member's nearest partners among the members of a meeting."""
    sq = (vecs * vecs).sum(1)
    d = sq[:, None] + sq[None, :] - 2 * (vecs @ vecs.T)
    np.fill_diagonal(d, np.inf)
    if fresh is not None:
        d[np.ix_(~fresh, ~fresh)] = np.inf
    k = min(offers, len(ids) - 1)
    part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(ids) else np.argsort(d, 1)[:, :k]
    dist = np.take_along_axis(d, part, 1)
    ok = np.isfinite(dist)
    return np.broadcast_to(ids[:, None], part.shape)[ok], ids[part][ok], np.maximum(dist[ok], 0).astype(np.float32)


def _start(dim: int, degree: int, buckets: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.v.to_numpy()).astype(np.float32)
        ids = pdf.id.to_numpy(np.int64)
        order = np.argsort(x @ np.random.default_rng(seed).standard_normal(dim).astype(np.float32), kind="stable")
        got = [_best(x[c], ids[c], None, min(degree, 24)) for i in range(0, len(order), LEAF) if len(c := order[i : i + LEAF]) > 1]
        if not got:
            return _rows([])
        return _rows(_offers(*map(np.concatenate, zip(*got, strict=True)), degree, buckets))

    return run


def _signs(dim: int, bits: int, tables: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.default_rng(3).standard_normal((tables, dim, max(1, bits))).astype(np.float32)
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack(pdf.v.to_numpy()).astype(np.float32)
            for t in range(tables):
                code = ((x @ planes[t] > 0) * (1 << np.arange(max(1, bits)))).sum(1) if bits else np.zeros(len(x), np.int64)
                yield pd.DataFrame({"code": code.astype(np.int64) * tables + t, "id": pdf.id, "v": pdf.v})

    return run


def _store(dim: int, degree: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        n = len(pdf)
        x = np.stack(pdf.v.to_numpy()).astype("<f4")
        return _rows([(int(pdf.bucket[0]), pdf.id.to_numpy("<i8").tobytes(), x.tobytes(), np.full((n, degree), -1, "<i8").tobytes(), np.full((n, degree), np.inf, "<f4").tobytes(), np.zeros((n, degree), "u1").tobytes())], STATE)

    return run


def _merge(dim: int, degree: int):
    """A bucket's lists with what was offered: the nearest distinct ones stay, new ones are marked."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        b = Bucket(row, dim, degree)
        n = len(b.ids)
        u = np.concatenate([np.repeat(np.arange(n), degree), b.at(_join(right.a, "<i8"))])
        v = np.concatenate([b.nb.ravel(), _join(right.b, "<i8")])
        d = np.concatenate([b.nd.ravel(), _join(right.x, "<f4")])
        w = np.concatenate([np.zeros(n * degree, np.uint8), np.ones(len(u) - n * degree, np.uint8)])
        ok = v >= 0
        u, v, d, w = u[ok], v[ok], d[ok], w[ok]
        order = np.lexsort((w, v, u))
        u, v, d, w = u[order], v[order], d[order], w[order]
        one = np.ones(len(u), bool)
        one[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        u, v, d, w = u[one], v[one], d[one], w[one]
        order = np.lexsort((v, d, u))
        u, v, d, w = u[order], v[order], d[order], w[order]
        rank = np.arange(len(u)) - np.searchsorted(u, np.arange(n))[u]
        keep = rank < degree
        nb, nd, nw = np.full((n, degree), -1, "<i8"), np.full((n, degree), np.inf, "<f4"), np.zeros((n, degree), "u1")
        at = u[keep], rank[keep]
        nb[at], nd[at], nw[at] = v[keep], d[keep], w[keep]
        return _rows([(int(row.bucket), row.ids, row.vecs, nb.tobytes(), nd.tobytes(), nw.tobytes())], STATE)

    return run


def _reverse(dim: int, degree: int, buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, row in pdf.iterrows():
                b = Bucket(row, dim, degree)
                ok = b.nb >= 0
                u, v, w = np.repeat(b.ids, degree)[ok.ravel()], b.nb[ok], b.nw[ok]
                yield _rows([(k, c[0].tobytes(), c[1].tobytes(), c[2].tobytes()) for k, c in _split(bucket_of(v, buckets), v, u, w)])

    return run


def _invite(dim: int, degree: int, buckets: int):
    """Every node tells the nodes that list it, and those it lists, that it comes; its vector goes once a bucket."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        b = Bucket(row, dim, degree)
        ok = b.nb >= 0
        me = np.concatenate([_join(right.a, "<i8"), np.repeat(b.ids, degree)[ok.ravel()]])
        host = np.concatenate([_join(right.b, "<i8"), b.nb[ok]])
        new = np.concatenate([_join(right.x, "u1"), b.nw[ok]])
        rows = []
        for k, (h, m, w) in _split(bucket_of(host, buckets), host, me, new):
            rows.append((k, h.tobytes(), m.tobytes(), w.tobytes()))
            who = np.unique(m)
            rows.append((k, b"", who.tobytes(), b.vecs[b.at(who)].tobytes()))
        return _rows(rows)

    return run


def _meet(dim: int, degree: int, buckets: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges, vecs = pdf[pdf.a.map(len) > 0], pdf[pdf.a.map(len) == 0]
        ids = _join(vecs.b, "<i8")
        x = _join(vecs.x, "<f4").reshape(len(ids), dim)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        host, me, new = _join(edges.a, "<i8"), np.searchsorted(ids, _join(edges.b, "<i8")), _join(edges.x, "u1").astype(bool)
        rnd = np.random.default_rng(seed).random(len(host))
        order = np.lexsort((rnd, ~new, host))  # new members first where a list must be cut
        host, me, new = host[order], me[order], new[order]
        edge = np.append(np.flatnonzero(np.append(True, host[1:] != host[:-1])), len(host))
        got, out, held = [], [], 0
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            m, first = np.unique(me[s : min(e, s + degree + REVERSE)], return_index=True)
            fresh = new[s:e][first]
            if len(m) < 2 or not fresh.any():
                continue
            r = _best(x[m], ids[m], fresh, OFFERS)
            got.append(r)
            held += len(r[0])
            if held > 1_000_000:
                out += [tuple(map(np.concatenate, zip(*got, strict=True)))]
                got, held = [], 0
        out += [tuple(map(np.concatenate, zip(*got, strict=True)))] if got else []
        return _rows([r for o in out for r in _offers(*o, degree, buckets)])

    return run


def _changed(dim: int, degree: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                w = np.frombuffer(row.nw, "u1")
                yield pd.DataFrame({"new": [int(w.sum())], "all": [len(w)]})

    return run


def build(nodes: DataFrame, dim: int, degree: int = DEGREE, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """The graph of (id, v) rows with distinct ids and vectors: a table of buckets, and their number."""
    spark = nodes.sparkSession
    ship(spark)
    n = nodes.count()
    buckets = int(max(1, min(partitions(spark), -(-n // 2048))))
    bits = min(16, max(0, int(np.ceil(np.log2(max(1, n / LEAF))))))
    placed = nodes.mapInPandas(_place(buckets), "bucket int, id long, v array<float>")
    state = placed.groupBy("bucket").applyInPandas(_store(dim, degree), STATE)
    first = nodes.mapInPandas(_signs(dim, bits, TABLES), "code long, id long, v array<float>").groupBy("code").applyInPandas(_start(dim, degree, buckets, 5), MESSAGE)
    state = stash(state.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInPandas(_merge(dim, degree), STATE))
    for i in range(rounds):
        row = state.select("nw").mapInPandas(_changed(dim, degree), "new long, all long").agg(F.sum("new"), F.sum("all")).first()
        if not row[0] or row[0] < QUIET * row[1]:
            break
        told = state.mapInPandas(_reverse(dim, degree, buckets), MESSAGE)
        come = state.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(_invite(dim, degree, buckets), MESSAGE)
        offers = come.groupBy("bucket").applyInPandas(_meet(dim, degree, buckets, i), MESSAGE)
        state = stash(state.groupBy("bucket").cogroup(offers.groupBy("bucket")).applyInPandas(_merge(dim, degree), STATE))
        free_shuffles(spark)
    return state, buckets


def _place(buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"bucket": bucket_of(pdf.id.to_numpy(np.int64), buckets), "id": pdf.id, "v": pdf.v})

    return run


# -- greedy search -------------------------------------------------------------

BEAM_STATE = "bucket int, q binary, vec binary, ids binary, d binary, done binary"


def _enter(dim: int, degree: int):
    """The query's own node: its list is the first beam."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _rows([], BEAM_STATE)
        b = Bucket(left.iloc[0], dim, degree)
        q = np.unique(right.id.to_numpy(np.int64))
        at = b.at(q)
        n = len(q)
        ids, d = np.full((n, BEAM), -1, "<i8"), np.full((n, BEAM), np.inf, "<f4")
        k = min(BEAM, degree)
        ids[:, :k], d[:, :k] = b.nb[at][:, :k], b.nd[at][:, :k]
        return _rows([(int(left.bucket.iloc[0]), q.astype("<i8").tobytes(), b.vecs[at].tobytes(), ids.tobytes(), d.tobytes(), np.zeros((n, BEAM), "u1").tobytes())], BEAM_STATE)

    return run


def _frontier(dim: int, buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                q, ids, done = np.frombuffer(row.q, "<i8"), np.frombuffer(row.ids, "<i8").reshape(-1, BEAM), np.frombuffer(row.done, "u1").reshape(-1, BEAM)
                x = np.frombuffer(row.vec, "<f4").reshape(len(q), dim)
                open_ = (ids >= 0) & (done == 0)
                pick = open_ & (np.cumsum(open_, 1) <= EXPAND)
                i, j = np.nonzero(pick)
                rows = []
                for k, (at, node) in _split(bucket_of(ids[i, j], buckets), i, ids[i, j]):
                    who = np.unique(at)
                    rows.append((k, q[at].tobytes(), node.tobytes(), b""))
                    rows.append((k, q[who].tobytes(), b"", x[who].tobytes()))
                yield _rows(rows)

    return run


def _expand(dim: int, degree: int, buckets: int):
    """Neighbours of the frontier go to their own buckets, each query's vector once."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _rows([])
        b = Bucket(left.iloc[0], dim, degree)
        edges, vecs = right[right.x.map(len) == 0], right[right.x.map(len) > 0]
        qs, x = _join(vecs.a, "<i8"), _join(vecs.x, "<f4").reshape(-1, dim)
        order = np.argsort(qs)
        qs, x = qs[order], x[order]
        q, nb = _join(edges.a, "<i8"), b.nb[b.at(_join(edges.b, "<i8"))]
        q, w = np.repeat(q, degree)[nb.ravel() >= 0], nb[nb >= 0]
        pair = np.unique(np.stack([q, w], 1), axis=0)
        rows = []
        for k, (q, w) in _split(bucket_of(pair[:, 1], buckets), pair[:, 0], pair[:, 1]):
            who = np.unique(q)
            rows.append((k, q.tobytes(), w.tobytes(), b""))
            rows.append((k, who.tobytes(), b"", x[np.searchsorted(qs, who)].tobytes()))
        return _rows(rows)

    return run


def _measure(dim: int, degree: int, buckets: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _rows([])
        b = Bucket(left.iloc[0], dim, degree)
        edges, vecs = right[right.x.map(len) == 0], right[right.x.map(len) > 0]
        qs, x = _join(vecs.a, "<i8"), _join(vecs.x, "<f4").reshape(-1, dim)
        qs, first = np.unique(qs, return_index=True)
        x = x[first]
        pair = np.unique(np.stack([_join(edges.a, "<i8"), _join(edges.b, "<i8")], 1), axis=0)
        pair = pair[pair[:, 0] != pair[:, 1]]
        d = np.empty(len(pair), "<f4")
        for i in range(0, len(pair), 1 << 16):
            s = slice(i, i + (1 << 16))
            diff = x[np.searchsorted(qs, pair[s, 0])] - b.vecs[b.at(pair[s, 1])]
            d[s] = (diff * diff).sum(1)
        return _rows(_offers(pair[:, 0].copy(), pair[:, 1].copy(), d, BEAM, buckets))

    return run


def _narrow(dim: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return _rows([], BEAM_STATE)
        row = left.iloc[0]
        q = np.frombuffer(row.q, "<i8")
        n = len(q)
        ids, d, done = (np.frombuffer(row[c], k).reshape(n, BEAM).copy() for c, k in (("ids", "<i8"), ("d", "<f4"), ("done", "u1")))
        open_ = (ids >= 0) & (done == 0)
        done[open_ & (np.cumsum(open_, 1) <= EXPAND)] = 1
        u = np.concatenate([np.repeat(np.arange(n), BEAM), np.searchsorted(q, _join(right.a, "<i8"))])
        v, e = np.concatenate([ids.ravel(), _join(right.b, "<i8")]), np.concatenate([d.ravel(), _join(right.x, "<f4")])
        f = np.concatenate([done.ravel(), np.zeros(len(u) - n * BEAM, "u1")])
        ok = v >= 0
        u, v, e, f = u[ok], v[ok], e[ok], f[ok]
        order = np.lexsort((1 - f, v, u))
        u, v, e, f = u[order], v[order], e[order], f[order]
        one = np.ones(len(u), bool)
        one[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        u, v, e, f = u[one], v[one], e[one], f[one]
        order = np.lexsort((v, e, u))
        u, v, e, f = u[order], v[order], e[order], f[order]
        rank = np.arange(len(u)) - np.searchsorted(u, np.arange(n))[u]
        keep = rank < BEAM
        ids, d, done = np.full((n, BEAM), -1, "<i8"), np.full((n, BEAM), np.inf, "<f4"), np.zeros((n, BEAM), "u1")
        at = u[keep], rank[keep]
        ids[at], d[at], done[at] = v[keep], e[keep], f[keep]
        return _rows([(int(row.bucket), row.q, row.vec, ids.tobytes(), d.tobytes(), done.tobytes())], BEAM_STATE)

    return run


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for row in pdf.itertuples():
            q, ids = np.frombuffer(row.q, "<i8"), np.frombuffer(row.ids, "<i8").reshape(-1, BEAM)
            i, j = np.nonzero(ids >= 0)
            yield pd.DataFrame({"q": q[i], "id": ids[i, j]})


def search(state: DataFrame, buckets: int, queries: DataFrame, dim: int, degree: int = DEGREE, hops: int = HOPS) -> DataFrame:
    """(q, id): the beam of each query node after greedy search; queries: (id) of nodes of the graph."""
    asked = queries.mapInPandas(_seat(buckets), "bucket int, id long")
    beam = stash(state.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(_enter(dim, degree), BEAM_STATE))
    for _ in range(hops):
        go = beam.mapInPandas(_frontier(dim, buckets), MESSAGE)
        out = state.groupBy("bucket").cogroup(go.groupBy("bucket")).applyInPandas(_expand(dim, degree, buckets), MESSAGE)
        met = state.groupBy("bucket").cogroup(out.groupBy("bucket")).applyInPandas(_measure(dim, degree, buckets), MESSAGE)
        beam = stash(beam.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInPandas(_narrow(dim), BEAM_STATE))
        free_shuffles(state.sparkSession)
    return beam.mapInPandas(_found, "q long, id long")


def _seat(buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"bucket": bucket_of(pdf.id.to_numpy(np.int64), buckets), "id": pdf.id})

    return run


def _least(k: int):
    """Of each node, the k smallest rows of a partition; a first step before they are ranked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf])
            held = held.drop_duplicates().sort_values(["id", "vec_id"]).groupby("id").head(k)
        if held is not None:
            yield held

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each query row.

    rows: (vec_id, embedding); queries: (vec_id) of rows.
    """
    spark = rows.sparkSession
    ship(spark)
    good = "embedding IS NOT NULL AND vec_id IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(embedding, x -> x <> 0)"
    rows = rows.where(good).select("vec_id", F.expr("transform(embedding, x -> float(x + 0.0))").alias("v")).withColumn("n", F.size("v"))
    dims = rows.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims[0][0]
    rows = rows.where(F.col("n") == dim).drop("n")
    nodes = stash(rows.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")).groupBy("id").agg(F.first("v").alias("v"), F.max("m").alias("m")))
    ids = rows.join(nodes.select("id", "v"), "v").select("vec_id", "id").distinct() if nodes.where("m > 1").limit(1).count() else nodes.select(F.col("id").alias("vec_id"), "id")
    ids = stash(ids)
    asked = ids.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "id")
    state, buckets = build(nodes.select("id", "v"), dim)
    hits = search(state, buckets, asked.select("id").distinct(), dim)
    # a node's answers: the smallest rows of the nodes found and of its own
    few = ids.mapInPandas(_least(k + 1), "vec_id long, id long")
    order = Window.partitionBy("id").orderBy("vec_id")
    few = few.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("id").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    both = hits.unionByName(asked.select(F.col("id").alias("q"), "id")).distinct()
    v = nodes.select("id", "v")
    met = both.join(v, "id").join(v.select(F.col("id").alias("q"), F.col("v").alias("w")), "q").join(few, "id")
    dist = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    lists = met.select("q", dist.alias("score"), "members").select("q", F.transform("members", lambda x: F.struct(F.col("score").alias("score"), x.alias("vec_id"))).alias("l"))
    ranked = lists.groupBy("q").agg(F.flatten(F.collect_list("l")).alias("l"))  # a beam's members, bounded
    ranked = ranked.select("q", F.slice(F.array_sort("l"), 1, k + 1).alias("l"))
    out = asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")).join(ranked, "q")
    out = out.select("query_id", F.posexplode(F.slice(F.filter("l", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("r", "x"))
    return out.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
