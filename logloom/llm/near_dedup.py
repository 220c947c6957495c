"""MinHash near-dedup with BagMinHash signatures of word 5-shingle multisets.

Every shingle of weight w (its count in the text) owns a Poisson process on
(0, w] x time.  Weights are discretised to whole numbers and the line is cut
into (0,1], (1,2], (2,4], (4,8] ...; each piece has a process of its own, and a
point in a piece that w covers only in part counts if its level is at most w.
Each register keeps the earliest point that falls on it, so two texts agree on
a register with the probability of their weighted Jaccard similarity.  Points
are made for all shingles of a batch at once, and only up to the time by which
a text's registers are full.

Signatures are banded; texts that share a band are candidates.  A group of m
texts is not expanded into its pairs: its first text is verified against all
others and classes are joined.  While a group holds more than one class, the
classes' first texts meet the first of them, and texts of different classes meet
where their signatures lie side by side, until no round finds a link.  These
rounds only make classes large early.  At the end, every pair of different
classes that shares a band meets in a cell (texts of a band and of like weight,
salted into blocks), in the first band that both share.  There the texts' bags
themselves are compared, each copy of a shingle an element of 32 bits: equal
elements count as shared, so the count is an upper bound, and it is exact but for
equal hashes.  A cell joins what it finds into trees and gives their edges only,
so its output is no larger than its texts; if verification ever refuses such an
edge, the cells are read once more and give every pair.  No link is lost.
Exact copies are one text from the start.  Verification compares the multisets
themselves: sum of minima over sum of maxima, 0.8 or more.

Defined results: null and empty texts are in no class but their own; a text of
fewer than five words has one shingle, all its words; letters A-Z are folded to
lower case; rows with equal text are one class however often they repeat; extra
columns are not read by the query; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship
from ._graph import components
from ._spark import cut, free_shuffles, stash, table, unused
from ._text import LOWER, U, column, flat, mix, owner, shingles, slices, word_hashes, words

REGISTERS, ROWS = 48, 3
SIMILAR = 0.8
ORDER = ("band", "n1", "n2", "n3")
BLOCK = 256  # texts of a block, about; a cell has two blocks at most
COLUMNS = 8192  # elements of a cell that are compared at once
SHINGLE = 5
_K = np.array([0x8CB92BA72F3D8DD7, 0xABE1D3F9B5C6D2E5, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U)


def bags(buf: np.ndarray, at: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with counts: (hash, count, n + 1 offsets), sorted by hash."""
    buf = LOWER[buf]
    starts, ends, offsets = words(buf, at)
    h = word_hashes(buf, starts, ends)
    n = np.diff(offsets)
    g = np.zeros(len(h), U)
    s = shingles(h, k)
    g[: len(s)] = s
    last = np.repeat(offsets[1:], n) - np.arange(len(h))
    keep = last >= k
    short = np.flatnonzero((n > 0) & (n < k))
    for i in short:
        x = h[offsets[i] : offsets[i + 1]]
        g[offsets[i]] = mix(np.add.reduce(x * _K[: len(x)], keepdims=True) + U(len(x)))[0]
        keep[offsets[i]] = True
    g, own = g[keep], owner(offsets)[keep]
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(g)))
    return g[first], counts, np.searchsorted(own[first], np.arange(len(at)))


def signatures(g: np.ndarray, counts: np.ndarray, offsets: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """BagMinHash: n x m register values; texts without shingles keep the largest value."""
    n = len(offsets) - 1
    own = owner(offsets)
    weight = np.bincount(own, counts, n)
    pieces = 1 + np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)
    sig = np.full(n * m, np.iinfo(U).max, U)
    open_ = np.flatnonzero(weight > 0)
    until = m * (np.log(m) + 4.0) / np.maximum(weight, 1)
    while len(open_):
        pick = np.zeros(n, bool)
        pick[open_] = True
        rows = np.flatnonzero(pick[own])
        e = np.repeat(rows, pieces[rows])
        j = np.arange(len(e)) - np.repeat(np.cumsum(pieces[rows]) - pieces[rows], pieces[rows])
        low = np.where(j == 0, 0, 1 << np.maximum(j - 1, 0))
        width = np.maximum(low, 1)
        seed = mix(g[e] + j.astype(U) * _K[0])
        doc, end, most = own[e], until[own[e]], counts[e]
        time, k = np.zeros(len(e)), 0
        while len(seed):
            k += 1
            r = mix(seed + _K[1] * np.full(1, k, U))
            time = time - np.log1p((r >> U(11)).astype(np.float64) * -(2.0**-53)) / width
            go = time < end
            seed, doc, end, most, time, low, width, r = (x[go] for x in (seed, doc, end, most, time, low, width, r))
            r2 = mix(r ^ _K[2])
            level = low + 1 + ((r2 >> U(40)) % width.astype(U)).astype(np.int64)
            hit = level <= most
            register = ((r2 & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
            stamp = (time.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (mix(r2 + _K[3]) >> U(32))
            np.minimum.at(sig, (doc * m + register)[hit], stamp[hit])
        full = (sig.reshape(n, m) != np.iinfo(U).max).all(1)
        open_ = open_[~full[open_]]
        until = until * 2
    return sig.reshape(n, m)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers."""
    n, m = sig.shape
    x = (sig & U(0xFFFFFFFF)).reshape(n, m // rows, rows)
    out = np.arange(m // rows, dtype=U)[None, :] * _K[0]
    for i in range(rows):
        out = mix(out + x[:, :, i] * _K[1])
    return out


def elements(g: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32 bits for every copy of a shingle, rising in each text, and n + 1 offsets.

    Two texts share as many elements as the sum of their shingle counts' minima, or more if hashes meet.
    """
    which = np.repeat(np.arange(len(g)), counts)
    copy = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    e = (mix(g[which] + copy.astype(U) * _K[1]) >> U(32)).astype("<u4")
    own = np.repeat(owner(offsets), counts)
    return e[np.lexsort((e, own))], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(offsets) - 1))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        g, counts, offsets = bags(*flat(column(batch, "text")))
        keys = bands(signatures(g, counts, offsets)).view(np.int64)
        some = np.flatnonzero(np.diff(offsets))
        keys = keys[some]
        lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * keys.shape[1], keys.ravel())
        yield pa.RecordBatch.from_arrays([column(batch, "node").take(pa.array(some)), column(batch, "doc_id").take(pa.array(some)), lists], names=["node", "doc_id", "keys"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        e, at = elements(*bags(*flat(column(batch, "text"))))
        data = [e[at[i] : at[i + 1]].tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(np.diff(at), pa.int64()), pa.array(data, pa.binary())], names=["node", "weight", "bag"])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two bags (sorted distinct hashes, counts)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    total = int(a[1].sum() + b[1].sum())
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / (total - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
    for batch in slices(batches, "tb"):
        a, b = column(batch, "a").to_pylist(), column(batch, "b").to_pylist()
        if len(held) > 64:
            held.clear()
        new = {x: i for i, x in enumerate(a) if x not in held}
        for name, want in (("ta", list(new.values())), ("tb", list(range(len(b))))):
            g, c, at = bags(*flat(column(batch, name).take(pa.array(want, pa.int64()))))
            found = [(g[at[i] : at[i + 1]], c[at[i] : at[i + 1]]) for i in range(len(want))]
            if name == "ta":
                held.update(zip(new, found, strict=True))
        j = [weighted_jaccard(held[x], y) for x, y in zip(a, found, strict=True)]
        yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(j, pa.float64())], names=["a", "b", "j"])


def node_of(text: Column) -> Column:
    """Texts are known by their MD5 digest, so copies are one node."""
    return F.unhex(F.md5(text.cast("binary")))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) with the similarity j of the texts of nodes a and b; a may be a hot leader."""
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    return pairs.join(tb, "b").join(ta, "a").mapInArrow(_verify, "a binary, b binary, j double")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(node, comp) of every text that has a near copy of other content."""
    spark = docs.sparkSession
    ship(spark)
    seen = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", "text", node_of(F.col("text")).alias("node"))
    signed = stash(seen.mapInArrow(_sign, "node binary, doc_id long, keys array<long>"))
    one = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"))
    # each band's row carries the next bands' keys, which put like texts side by side
    n = REGISTERS // ROWS
    turn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(*[F.element_at("keys", ((i + j) % n + 1).cast("int")).alias(c) for j, c in enumerate(ORDER)]))
    rows = one.select("node", "least", F.explode(turn).alias("k")).select("node", "least", "k.*")
    many = rows.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
    members = stash(rows.join(many, "band"))
    needed = members.select("node").distinct()
    texts = stash(seen.join(needed, "node").groupBy("node").agg(F.first("text").alias("text")))
    free_shuffles(spark)
    head = F.struct(F.col("least").isNull().alias("o"), "least", "node")
    first = members.groupBy("band").agg(F.min(head).alias("h")).select("band", F.col("h.node").alias("a"))
    pairs = members.select("band", F.col("node").alias("b")).join(first, "band").where("a <> b").select("a", "b").distinct()
    comp, edges, tested, closing = None, None, None, 0
    while True:
        if tested is not None and closing != 1:  # a tree's edges count only if all of them hold
            known = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        done = stash(verify(pairs, texts))
        good = done.where(F.col("j") >= similar).select("a", "b")
        tested = done.select("a", "b") if tested is None else tested.unionByName(done.select("a", "b"))
        n, linked = done.agg(F.count("*"), F.count_if(F.col("j") >= similar)).first()
        if linked:
            edges = good if edges is None else edges.unionByName(good)
            comp = cut(components(edges))
            free_shuffles(spark)
        if closing == 2 or (closing == 1 and n == linked):
            break
        # bands that still hold several classes
        m = members.withColumn("comp", F.col("node")) if comp is None else members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        some = m.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
        m = stash(m.join(some, "band"))
        if closing or not linked:  # the rounds end: all that is left is compared at once
            closing += 1
            pairs = stash(_cells(m, one.select("node", "keys"), texts, similar, trees=closing == 1))
            continue
        # their heads meet the first of them, and texts of different classes meet where
        # their signatures lie side by side
        heads = m.groupBy("band", "comp").agg(F.min(head).alias("h"))
        lead = heads.groupBy("band").agg(F.min("h").alias("l"))
        star = heads.join(lead, "band").where("h <> l").select(F.col("l.node").alias("a"), F.col("h.node").alias("b"))
        laid = m.select(*ORDER, "node", "comp").repartitionByRange(*ORDER, "node").sortWithinPartitions(*ORDER, "node")
        side = laid.mapInArrow(_neighbours, "a binary, b binary")
        pairs = star.unionByName(side).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if comp is None:
        return spark.createDataFrame([], "node binary, comp binary")
    return comp


def _cells(m: DataFrame, keys: DataFrame, texts: DataFrame, similar: float, trees: bool = True) -> DataFrame:
    """Pairs (a, b) of different classes that share a band and may be similar; with ``trees``, enough of them to join the rest.

    Weights of similar texts lie in one class of weights or in two next to one another:
    a text is at home in its own class and visits the class below if that may hold texts like it.
    """
    some = m.select("node").distinct()
    bag = texts.join(some, "node").mapInArrow(_bags, "node binary, weight long, bag binary")
    bag = stash(bag.join(keys.join(some, "node"), "node"))
    base = 3 * float(np.log(1 / similar)) + 1e-6
    rows = m.select("band", "node", "comp").join(bag, "node")
    own = F.floor(F.log("weight") / F.lit(base)).cast("int")
    below = F.col("weight") * F.lit(similar - 1e-6) < F.exp(F.col("own") * F.lit(base))
    rows = rows.withColumn("own", own).withColumn("q", F.explode(F.when(below, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))
    rows = rows.withColumn("home", F.col("own") == F.col("q")).drop("own")
    size = rows.groupBy("band", "q").agg(F.count("*").alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("home").alias("any"))
    size = size.where("x <> y AND any").select("band", "q", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(size, ["band", "q"]).withColumn("salt", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["cell", "band", "q", "s", "t"]
    rows = rows.withColumn("s", F.least("salt", "other")).withColumn("t", F.greatest("salt", "other")).withColumn("cell", F.xxhash64("band", "q", "s", "t"))
    laid = rows.select(*place, "salt", "home", "node", "comp", "weight", "keys", "bag").repartition(F.col("cell")).sortWithinPartitions(*place)
    return laid.mapInArrow(_meet(similar, trees), "a binary, b binary").distinct()


def shared_elements(bags_: list[np.ndarray]) -> np.ndarray:
    """n x n numbers of shared elements, by products of their incidence matrix, COLUMNS of it at once."""
    n = len(bags_)
    flat_ = np.concatenate(bags_)
    own = np.repeat(np.arange(n), [len(x) for x in bags_])
    _, at, times = np.unique(flat_, return_inverse=True, return_counts=True)
    several = times > 1
    place = np.cumsum(several) - 1
    keep = several[at]
    col, row = place[at[keep]], own[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(several.sum()), COLUMNS):
        i, j = np.searchsorted(col, [low, low + COLUMNS])
        x = np.zeros((n, min(COLUMNS, int(several.sum()) - low)), np.float32)
        np.add.at(x, (row[i:j], col[i:j] - low), 1)
        out += x @ x.T
    return out


def _meet(similar: float, trees: bool):
    def cell(part: pa.RecordBatch) -> list[tuple[bytes, bytes]]:
        comp, node = column(part, "comp").to_pylist(), column(part, "node").to_pylist()
        if len(set(comp)) < 2:
            return []
        salt, home, w = (column(part, c).to_numpy(zero_copy_only=False) for c in ("salt", "home", "weight"))
        own, band, within = column(part, "s")[0].as_py() == column(part, "t")[0].as_py(), column(part, "band")[0].as_py(), np.array([hash(c) for c in comp])
        both = shared_elements([np.frombuffer(x, "<u4") for x in column(part, "bag").to_pylist()])
        both = both.astype(np.float64)
        may = both / np.maximum(w[:, None] + w[None, :] - both, 1) >= similar
        may &= home[:, None] | home[None, :]  # two visitors meet in the class above
        if not own:  # a pair of one salt belongs to that salt's own cell
            may &= salt[:, None] != salt[None, :]
        i, j = np.nonzero(np.triu(may, 1))
        if not len(i):
            return []
        differ = (within[i] != within[j]) | np.array([comp[x] != comp[y] for x, y in zip(i, j, strict=True)])
        keys = np.array(column(part, "keys").to_pylist(), np.int64)
        same = keys[i] == keys[j]
        differ &= keys[i, same.argmax(1)] == band  # the first band that both share
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for x, y in zip(i[differ], j[differ], strict=True):
            if trees:
                a, b = root(comp[x]), root(comp[y])
                if a == b:
                    continue
                up[a] = b
            out.append((min(node[x], node[y]), max(node[x], node[y])))
        return out

    def met(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        new = np.ones(whole.num_rows, bool)
        new[1:] = False
        for c in ("cell", "band", "q", "s", "t"):
            x = column(whole, c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        edge = np.append(np.flatnonzero(new), whole.num_rows)
        found = [p for i, j in zip(edge[:-1], edge[1:], strict=True) if j - i > 1 for p in cell(whole.slice(i, j - i))]
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            cells = column(whole, "cell").to_numpy()
            at = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on in the next batch
            if at:
                yield from met(whole.slice(0, at))
            rest = whole.slice(at)
        if rest is not None:
            yield from met(rest)

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows that follow one another, of one band and different classes."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
        last = batch.slice(batch.num_rows - 1)
        band, comp, node = column(whole, "band").to_numpy(), column(whole, "comp").to_pylist(), column(whole, "node")
        at = [i for i in np.flatnonzero(band[1:] == band[:-1]) if comp[i] != comp[i + 1]]
        at = np.array(at, np.int64)
        yield pa.RecordBatch.from_arrays([node.take(pa.array(at)), node.take(pa.array(at + 1))], names=["a", "b"])


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, class_id (its class's least doc_id) and class_size."""
    comp = classes(docs, similar)
    nodes = docs.select("doc_id", F.when(F.length("text") > 0, node_of(F.col("text"))).alias("node"))
    known = nodes.where("node IS NOT NULL").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = known.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = known.join(per, "comp").select("doc_id", "class_id", "class_size")
    alone = nodes.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The input's rows, one of each class: that of the least doc_id, once.

    Columns of any name are kept; of rows that repeat a doc_id and a text, one stays.
    """
    comp = classes(docs, similar)
    row = unused(docs, "row")
    tagged = docs.select(F.struct(*docs.columns).alias(row), "doc_id", F.when(F.length("text") > 0, node_of(F.col("text"))).alias("node"))
    slim = tagged.where("node IS NOT NULL").select("doc_id", "node").join(comp, "node", "left")
    first = slim.groupBy(F.coalesce("comp", "node").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "node")).alias("h"))
    first = first.select(F.col("h.node").alias("node"), F.col("h.doc_id").alias("id"))
    kept = tagged.join(first, "node").where(F.col("doc_id").eqNullSafe(F.col("id"))).dropDuplicates(["node"]).select(row)
    return kept.unionByName(tagged.where("node IS NULL").select(row)).select(f"{row}.*")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
