"""Benchmark decontamination by latent semantic retrieval.

Terms are the benchmark's words; of each item at least its rarest ones count,
common ones only if few passages hold them.  All documents are cut into blocks
of sixteen words and passages are runs of blocks.  One pass counts in how many
passages each term stands; a second multiplies the TF-IDF matrix of all passages
and its transpose with a random matrix, from which the leading right singular
vectors follow (randomised SVD from one sketch).  In the third pass passages of
an item's length that lie close to it in the latent space are candidates, and
the words themselves decide: the longest common subsequence of item and passage
holds 80% of the item, or half of it and the item's answer words in their order
(a paraphrase).

The benchmark is read in blocks of items of bounded size; a block's terms and
vectors are what executors get.  Documents are never shuffled.

Defined results: null and empty texts match nothing; items without words match
nothing; A-Z are folded and ASCII punctuation parts words; items of equal text
are found each; rows repeated in the documents are found each; an empty
benchmark or table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .._ship import ship
from ._spark import stash, table, unused
from ._text import LOWER, U, column, flat, slices, word_hashes, words

BLOCK = 16  # words
ITEMS = 256  # items handled at once
ITEM_BYTES = 1 << 20
RANK = 256
EXTRA = 16
CHUNK = 128  # terms whose part of the sketch is summed at once
FAN = 64  # matrices of a chunk that a task adds up for each level
COMMON = 0.002  # share of passages above which a term is common
NEAR = 0.45  # cosine of a candidate
LCS, PARAPHRASE, ANSWER = 0.8, 0.5, 0.8
ANSWER_WORDS = 5
PUNCT = LOWER.copy()
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def tokens(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and their offsets."""
    buf = PUNCT[buf]
    s, e, o = words(buf, at)
    return word_hashes(buf, s, e), o


@dataclass
class Space:
    """A block of benchmark items, its terms and, once fitted, its latent space."""

    ids: list
    items: list[np.ndarray]  # word hashes
    terms: np.ndarray  # rising hashes
    idf: np.ndarray | None = None
    vectors: np.ndarray | None = None  # terms x rank, weighted by idf
    scales: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)  # blocks, items, unit vectors
    answers: list[np.ndarray] = field(default_factory=list)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term of each word, or -1: a table by the hash's top bits, then the rare second tries."""
        if not hasattr(self, "_slots"):
            bits = 18
            top = (self.terms >> U(64 - bits)).astype(np.int64)
            self._slots = np.searchsorted(top, np.arange((1 << bits) + 1)).astype(np.int32)
            self._bits = bits
        top = (h >> U(64 - self._bits)).astype(np.int64)
        at, end = self._slots[top], self._slots[top + 1]
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(at < end)
        at, end = at[some].astype(np.int64), end[some]
        while len(some):
            hit = self.terms[at] == h[some]
            out[some[hit]] = at[hit]
            at += 1
            go = ~hit & (at < end)
            some, at, end = some[go], at[go], end[go]
        return out


def _passages(o: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Passage of every word (numbered over all texts) and the first passage of each text."""
    n = np.diff(o)
    count = -(-n // size)
    first = np.concatenate([[0], np.cumsum(count)])
    own = np.repeat(np.arange(len(n)), n)
    return first[own] + (np.arange(int(o[-1])) - o[own]) // size, first


def _document_counts(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(space.terms)
        total, seen = np.zeros(d, np.int64), 0
        for batch in slices(batches, most=1 << 19):
            h, o = tokens(*flat(column(batch, "text")))
            p, first = _passages(o, 4 * BLOCK)
            t = space.lookup(h)
            on = t >= 0
            for i in range(0, int(first[-1]), 4096):  # a mark for each passage and term
                part = on & (p >= i) & (p < i + 4096) if first[-1] > 4096 else on
                mark = np.zeros(min(4096, int(first[-1]) - i) * d, bool)
                mark[(p[part] - i) * d + t[part]] = True
                total += mark.reshape(-1, d).sum(0)
            seen += int(first[-1])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], seen))], names=["term", "n"])

    return run


def _sketch(space: Space, omega_seed: int, width: int):
    """Rows of the transpose times the matrix times a random matrix, in chunks of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(space.terms)
        omega = (np.random.default_rng(omega_seed).standard_normal((d, width)) * space.idf[:, None]).astype(np.float32)
        out = np.zeros((d, width))
        for batch in slices(batches, most=1 << 20):
            h, o = tokens(*flat(column(batch, "text")))
            t = space.lookup(h)
            on = np.flatnonzero(t >= 0)
            if not len(on):
                continue
            p, t = _passages(o, 4 * BLOCK)[0][on], t[on]
            heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            rows = np.add.reduceat(omega[t], heads, axis=0)
            which = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(p))))
            order = np.argsort(t, kind="stable")
            at = np.flatnonzero(np.append(True, t[order][1:] != t[order][:-1]))
            out[t[order][at]] += np.add.reduceat(rows[which[order]], at, axis=0)
        out *= space.idf[:, None]
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        for i in range(0, d, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part], pa.int64()), pa.array([out[i : i + CHUNK].tobytes()])], names=["chunk", "part", "data"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(pdf["data"].iloc[0], np.float64).copy()
    for x in pdf["data"].iloc[1:]:
        total += np.frombuffer(x, np.float64)
    return pd.DataFrame({"chunk": [pdf.chunk.iloc[0]], "part": [pdf.part.iloc[0]], "data": [total.tobytes()]})


def _lcs(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def judge(item: np.ndarray, answer: np.ndarray, text: np.ndarray) -> tuple[float, int, str | None]:
    """(share of the item in the text's best stretch, where that starts, kind of match)."""
    n = len(item)
    span = min(len(text), n + max(4, n // 4))
    inside = np.isin(text, item)
    run = np.concatenate([[0], np.cumsum(inside)])
    start = int((run[span:] - run[: len(run) - span]).argmax())
    if run[start + span] - run[start] < PARAPHRASE * n:
        return 0.0, start, None
    part = text[start : start + span]
    share = _lcs(item, part) / n
    if share >= LCS:
        return share, start, "verbatim"
    if share >= PARAPHRASE and len(answer) and _lcs(answer, part) >= ANSWER * len(answer):
        return share, start, "paraphrase"
    return share, start, None


def _search(space: Space, near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.vstack([space.vectors, np.zeros((1, space.vectors.shape[1]))]).astype(np.float32)
        for batch in slices(batches, most=1 << 20):
            h, o = tokens(*flat(column(batch, "text")))
            if not len(h):
                continue
            t = space.lookup(h)
            p, first = _passages(o, BLOCK)
            on = np.flatnonzero(t >= 0)
            if not len(on):
                continue
            # blocks with a term; passages that start at another block hold no more than the next one
            q = p[on]
            heads = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            block, text = q[heads], np.searchsorted(o, on[heads], "right") - 1
            blocks = np.add.reduceat(v[t[on]], heads, axis=0)
            rows, reach = blocks.copy(), 1
            best: dict[tuple[int, int], tuple] = {}
            for size, which, units in space.scales:
                for k in range(reach, size):
                    at = np.minimum(np.searchsorted(block, block + k), len(block) - 1)
                    has = np.flatnonzero((block[at] == block + k) & (text[at] == text))
                    rows[has] += blocks[at[has]]
                reach = size
                norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
                some = np.flatnonzero(norm > 0)
                for i in range(0, len(some), 8192):
                    s = some[i : i + 8192]
                    cos = rows[s] @ units.T / norm[s][:, None]
                    for a, b in zip(*np.nonzero(cos >= near), strict=True):
                        x, item = int(text[s[a]]), int(which[b])
                        if (x, item) in best and best[x, item][1] >= 1:
                            continue
                        lo = int(o[x] + (block[s[a]] - first[x]) * BLOCK)
                        low, high = max(int(o[x]), lo - BLOCK), min(int(o[x + 1]), lo + (size + 1) * BLOCK)
                        share, at, kind = judge(space.items[item], space.answers[item], h[low:high])
                        if kind and ((x, item) not in best or share > best[x, item][1]):
                            best[x, item] = (low + at - int(o[x]), share, float(cos[a, b]), kind)
            if best:
                keys = sorted(best)
                rows_ = [best[k] for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").take(pa.array([k[0] for k in keys])), pa.array([space.ids[k[1]] for k in keys], pa.int64()), pa.array([r[0] for r in rows_], pa.int64()), pa.array([r[1] for r in rows_], pa.float64()), pa.array([min(1.0, r[2]) for r in rows_], pa.float64()), pa.array([r[3] for r in rows_])],
                    names=["doc_id", "item_id", "start_word", "share", "cosine", "kind"],
                )

    return run


def item_blocks(benchmark: DataFrame) -> Iterator[Space]:
    """Blocks of at most ITEMS items and ITEM_BYTES bytes, in the order of their ids."""
    rows: list[tuple] = []
    size = 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1])
        if len(rows) == ITEMS or size >= ITEM_BYTES:
            yield _space(rows)
            rows, size = [], 0
    if rows:
        yield _space(rows)


def _space(rows: list[tuple]) -> Space:
    h, o = tokens(*flat(pa.array([x[1] for x in rows], pa.string())))
    items = [h[o[i] : o[i + 1]] for i in range(len(rows))]
    some = [i for i, x in enumerate(items) if len(x)]
    return Space([rows[i][0] for i in some], [items[i] for i in some], np.unique(h))


def fit(docs: DataFrame, space: Space, rank: int = RANK) -> Space:
    """Counts terms, picks those that tell passages apart, and finds the latent space of all passages."""
    counted = docs.select("text").mapInArrow(_document_counts(space), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r[0]: r[1] for r in counted.collect()}  # one row a term of the block
    n = np.array([found.get(i, 0) for i in range(len(space.terms))], np.float64)
    passages = max(1, found.get(-1, 0))
    informative = n <= COMMON * passages
    for item in space.items:  # at least a third of an item's terms, four of them, whatever their counts
        t = np.unique(np.searchsorted(space.terms, item))
        informative[t[np.argsort(n[t], kind="stable")][: max(4, len(t) // 3)]] = True
    keep = np.flatnonzero(informative)
    idf = np.log((passages + 1) / (n[keep] + 0.5)) + 0.1
    space = Space(space.ids, space.items, space.terms[keep], np.maximum(idf, 0.1))
    d = len(keep)
    width = min(d, rank + EXTRA)
    parts = docs.select("text").mapInArrow(_sketch(space, 11, width), "chunk long, part long, data binary")
    # a tree of sums: no task adds up more than FAN matrices of a chunk for each level
    left = docs.select("text").rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("chunk", "part").applyInPandas(_add, "chunk long, part long, data binary")
    y = np.zeros((d, width))
    for r in parts.collect():  # terms x width numbers, bounded by the block of items
        y[r.chunk : r.chunk + CHUNK] += np.frombuffer(r["data"], np.float64).reshape(-1, width)
    omega = np.random.default_rng(11).standard_normal((d, width))
    if not y.any():
        basis = np.eye(d, min(d, width))
    else:
        q, _ = np.linalg.qr(y)
        # the sketch alone gives the small matrix: (Q' A'A Q)(Q' omega) = Q' y
        small = np.linalg.lstsq((q.T @ omega).T, (q.T @ y).T, rcond=None)[0].T
        values, rot = np.linalg.eigh((small + small.T) / 2)
        basis = q @ rot[:, np.argsort(-values)[:rank]]
    space.vectors = (basis * space.idf[:, None]).astype(np.float32)
    by: dict[int, list[int]] = {}
    units = []
    for i, item in enumerate(space.items):
        t = space.lookup(item)
        v = space.vectors[t[t >= 0]].sum(0)
        norm = np.sqrt((v * v).sum())
        units.append(v / norm if norm > 0 else v)
        by.setdefault(1 + -(-len(item) // BLOCK), []).append(i)
        # the answer: the item's words that say most, in the item's order
        w = np.where(t >= 0, space.idf[np.maximum(t, 0)], 0)
        space.answers.append(item[np.sort(np.argsort(-w, kind="stable")[:ANSWER_WORDS])])
    space.scales = [(size, np.array(which), np.array([units[i] for i in which], np.float32)) for size, which in sorted(by.items())]
    return space


def contaminated(docs: DataFrame, benchmark: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, item_id, start_word, share, cosine and kind of each item found in a document."""
    ship(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast(LongType()).alias("doc_id"), "text").where("text IS NOT NULL AND text <> ''")
    schema = "doc_id long, item_id long, start_word long, share double, cosine double, kind string"
    out = None
    for space in item_blocks(benchmark):
        if not space.items:
            continue
        found = docs.mapInArrow(_search(fit(docs, space), near), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input's rows that hold no benchmark item; rows are told apart by id and text."""
    row = unused(docs, "row")
    tagged = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = contaminated(tagged.select(F.col(row).alias("doc_id"), "text"), benchmark)
    bad = stash(found.select(F.col("doc_id").alias(row)).distinct())
    return tagged.join(bad, row, "left_anti").select(docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
