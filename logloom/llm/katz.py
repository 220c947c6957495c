"""LM scoring with a Katz backoff bigram model.

Counts are Good-Turing discounted up to a count of five; what the discounts free
goes to unseen words by exactly normalised backoff weights, and the base is the
unigram model with half a count added, so that every conditional distribution
sums to one over the training vocabulary and one unknown word.

A token's probability is found recursively: the discounted bigram if training
has it, else the context's weight times the base.  A context that training never
saw has weight one.

Texts are packed into batches; the distinct words and bigrams of a batch go to
buckets of a partitioned table by their hash, counted before they are sent, and
each batch gets back the corpus counts of its own keys, in its own order.  So a
frequent word or bigram costs a bucket one entry a batch, and nothing is joined
per token.  Backoff weights follow the same way: the batch that owns a bigram
(the first that has it in training) adds it to its context's sums, and the
context's bucket answers each document's unseen tokens with one sum.

Keys are 48-bit hashes.  Where fewer counts of counts are there than Good-Turing
needs, fewer counts are discounted by it, and at the last half a count is taken
off every count up to five.  A context that frees no mass counts one more.

Defined results: null is the empty text, which has its end token only; a null id
falls into training; rows may repeat; no rows give no rows; texts of any length
are scored whole; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship
from ._spark import free_shuffles, partitions, stash, table
from ._text import LOWER, U, column, flat, mix, word_hashes, words
from .language import fold

BATCH = 8 << 20  # bytes of text in a batch
PIECE = 1 << 20  # bytes hashed at once
KEEP = 5  # counts above this are not discounted
BITS = U(16)  # hash bits that are dropped
END, START = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
_A, _B = U(0x9E6C63D0876A9A47), U(0xE7037ED1A0B428DB)


# -- packing ---------------------------------------------------------------


def pack_numbers(x: np.ndarray) -> bytes:
    """Non-negative whole numbers, one byte each and four more for those of 255 and above."""
    big = x[x >= 255].astype("<u4")
    return np.uint32(len(x)).tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + big.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u4", -1, 4 + n)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising 48-bit keys as four-byte steps; longer steps are written out."""
    step = np.diff(keys, prepend=U(0))
    long = step >= U(0xFFFFFFFF)
    small = np.where(long, U(0xFFFFFFFF), step).astype("<u4")
    return np.uint32(len(keys)).tobytes() + small.tobytes() + step[long].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    step = np.frombuffer(data, "<u4", n, 4).astype(U)
    step[step == U(0xFFFFFFFF)] = np.frombuffer(data, "<u8", -1, 4 + 4 * n)
    return np.cumsum(step)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BATCH bytes of text, compressed, with ids and folds."""
    import zstandard

    held: list[tuple[bytes, object, bool]] = []
    size = 0

    def row() -> pa.RecordBatch:
        data = zstandard.ZstdCompressor(3).compress(b"".join(x[0] for x in held))
        lengths = np.array([len(x[0]) for x in held], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([[x[1] for x in held]], pa.list_(pa.int64())), pa.array([[x[2] for x in held]], pa.list_(pa.bool_())), pa.array([lengths.tobytes()]), pa.array([data])],
            names=["bid", "ids", "train", "lengths", "data"],
        )

    for batch in batches:
        buf, at = flat(column(batch, "text"))
        ids, train = column(batch, "doc_id").to_pylist(), column(batch, "train").to_pylist()
        for i in range(batch.num_rows):
            held.append((LOWER[buf[at[i] : at[i + 1]]].tobytes(), ids[i], train[i]))
            size += int(at[i + 1] - at[i])
            if size >= BATCH:
                yield row()
                held, size = [], 0
    if held:
        yield row()


@dataclass
class Tokens:
    """A batch's tokens by their distinct words and bigrams."""

    train: np.ndarray  # of each document
    at: np.ndarray  # n + 1 offsets of the documents' tokens
    words: np.ndarray  # distinct words, rising
    word: np.ndarray  # of each token
    pairs: np.ndarray  # distinct bigrams, rising
    pair: np.ndarray  # of each token
    first: np.ndarray  # one token of each bigram

    @classmethod
    def of(cls, train: np.ndarray, lengths: np.ndarray, data: bytes) -> Tokens:
        import zstandard

        buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(lengths.sum()))), np.uint8) if lengths.sum() else np.zeros(0, np.uint8)
        at = np.concatenate([[0], np.cumsum(lengths)])
        hashes, counts, i = [], [], 0
        while i < len(lengths):
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
            part = buf[at[i] : at[j]]
            s, e, o = words(part, at[i : j + 1] - at[i])
            hashes.append(word_hashes(part, s, e))
            counts.append(np.diff(o))
            i = j
        n = np.concatenate(counts)
        ends = np.cumsum(n + 1) - 1  # every document's last token is its end
        h = np.full(int(n.sum()) + len(n), END, U)
        h[np.delete(np.arange(len(h)), ends)] = np.concatenate(hashes)
        context = np.empty(len(h), U)
        context[1:] = h[:-1]
        at = np.append(0, ends + 1)
        context[at[:-1]] = START
        w, word = np.unique(h >> BITS, return_inverse=True)
        pairs, first, pair = np.unique(mix(context * _A + h * _B) >> BITS, return_index=True, return_inverse=True)
        return cls(train, at, w, word, pairs, pair, first)

    def trained(self) -> np.ndarray:
        return np.repeat(self.train, np.diff(self.at))

    def context(self, tokens: np.ndarray) -> np.ndarray:
        """Index of the word before each token, -1 at a document's start."""
        starts = np.zeros(len(self.word), bool)
        starts[self.at[:-1]] = True
        return np.where(starts[tokens], -1, self.word[np.maximum(tokens - 1, 0)])


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Offsets of the buckets' shares of rising 48-bit keys."""
    edges = np.array([(i << 48) // buckets for i in range(1, buckets)], U)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _read(batch: pa.RecordBatch, i: int) -> Tokens:
    train = np.array(column(batch, "train")[i].as_py(), bool)
    return Tokens.of(train, np.frombuffer(column(batch, "lengths")[i].as_py(), np.int64), column(batch, "data")[i].as_py())


def _requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, bid = _read(batch, i), column(batch, "bid")[i].as_py()
                on = t.trained()
                rows = []
                for kind, keys, which in ((1, t.words, t.word), (2, t.pairs, t.pair)):
                    count = np.bincount(which[on], minlength=len(keys))
                    cuts = _cuts(keys, buckets)
                    for b in np.flatnonzero(np.diff(cuts)):
                        s = slice(cuts[b], cuts[b + 1])
                        rows.append((kind, int(b), bid, pack_keys(keys[s]), pack_numbers(count[s])))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "bucket", "bid", "keys", "counts"])

    return run


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket: corpus counts of all keys, and for each batch those of its own, with what it owns."""
    pdf = pdf.sort_values("bid", ignore_index=True)
    keys = [unpack_keys(x) for x in pdf["keys"]]
    counts = np.concatenate([unpack_numbers(x) for x in pdf.counts])
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, counts, len(every)).astype(np.int64)
    mine = counts > 0
    owned = np.zeros(len(counts), bool)
    place = np.flatnonzero(mine)[::-1]
    first = np.full(len(every), -1, np.int64)
    first[back[place]] = place
    owned[first[first >= 0]] = True
    kind, bucket = int(pdf.kind[0]), int(pdf.bucket[0])
    rows = [(int(b), kind, bucket, pack_numbers(total[back[at[i] : at[i + 1]]]), np.packbits(owned[at[i] : at[i + 1]]).tobytes(), None) for i, b in enumerate(pdf.bid)]
    stats = [int(total.sum()), int((total > 0).sum()), *np.bincount(total[total <= KEEP + 1], minlength=KEEP + 2)[1 : KEEP + 2].tolist()]
    rows.append((-1, kind, bucket, b"", b"", stats))
    return pd.DataFrame(rows, columns=["bid", "kind", "bucket", "counts", "owned", "stats"])


# -- the model ---------------------------------------------------------------


def discounts(n: list[int], keep: int = KEEP) -> np.ndarray:
    """Factor for each count from 0 to ``keep``; n[r - 1] is how many bigrams occur r times."""
    for k in range(keep, 0, -1):
        if min(n[: k + 1]) <= 0:
            continue
        share = (k + 1) * n[k] / n[0]
        d = np.array([((r + 1) * n[r] / (r * n[r - 1]) - share) / (1 - share) if share != 1 else 0 for r in range(1, k + 1)])
        if ((d > 0) & (d < 1)).all():
            return np.concatenate([[1.0], d, np.ones(keep - k)])
    return np.concatenate([[1.0], [(r - 0.5) / r for r in range(1, keep + 1)]])


@dataclass
class Totals:
    tokens: int
    vocabulary: int
    documents: int  # of training
    discount: np.ndarray

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1))

    def kept(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return count * np.where(count <= KEEP, self.discount[np.minimum(count, KEEP)], 1.0)


def _scores(totals: Totals, buckets: int):
    """A batch with its counts: the documents' sums so far, and what its contexts' buckets must know."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        t = Tokens.of(np.array(row.train, bool), np.frombuffer(row.lengths, np.int64), row["data"])
        got = {}
        for kind in (1, 2):
            part = right[right.kind == kind].sort_values("bucket")
            counts = [unpack_numbers(x) for x in part.counts]
            owned = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)) for x, c in zip(part.owned, counts, strict=True)]
            got[kind] = np.concatenate(counts), np.concatenate(owned).astype(bool)
        (c1, _), (c2, own) = got[1], got[2]
        base = totals.base(c1)
        doc = np.repeat(np.arange(len(t.train)), np.diff(t.at))
        n = len(t.train)
        # of each distinct bigram: context, its count, and the part of the score that needs nothing else
        ctx, last = t.context(t.first), t.word[t.first]
        ch = np.where(ctx < 0, totals.documents, c1[ctx])
        seen, known = c2 > 0, ch > 0
        part = np.where(seen, np.log10(np.maximum(totals.kept(c2), 1e-300) / np.maximum(ch, 1)), np.log10(base[last]))
        score = np.bincount(doc, part[t.pair], n)
        known_words = np.bincount(doc, (c1 > 0)[t.word], n).astype(np.int64)
        base_score = np.bincount(doc, np.log10(base)[t.word], n)
        # contexts by place: START first, then the batch's words
        slot = ctx + 1
        keys = np.append(START >> BITS, t.words)
        mass = np.bincount(slot[own], totals.kept(c2[own]), len(keys))
        lower = np.bincount(slot[own], base[last[own]], len(keys))
        frees = np.zeros(len(keys), bool)  # contexts with a discounted bigram here
        frees[slot[seen & (totals.kept(c2) < c2)]] = True
        ask = np.where(seen, ~frees[slot], known)[t.pair]
        lookup = doc[ask] * len(keys) + slot[t.pair[ask]]
        unseen = ~seen[t.pair[ask]]
        at, back = np.unique(lookup, return_inverse=True)
        u = np.bincount(back, unseen, len(at)).astype(np.int64)
        m = np.bincount(back, ~unseen, len(at)).astype(np.int64)
        d, s = at // len(keys), at % len(keys)
        need = np.zeros(len(keys), bool)
        need[s] = True
        need |= lower > 0
        need = np.flatnonzero(need)
        order = need[np.argsort(keys[need], kind="stable")]
        rank = np.full(len(keys), -1)
        rank[order] = np.arange(len(order))
        counts = np.append(totals.documents, c1)[order]
        cuts = _cuts(keys[order], buckets)
        sort = np.argsort(rank[s], kind="stable")
        d, r, u, m = d[sort], rank[s][sort], u[sort], m[sort]
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):
            a, z = cuts[b], cuts[b + 1]
            i, j = np.searchsorted(r, [a, z])
            k = order[a:z]
            rows.append((row.bid, int(b), pack_keys(keys[k]), counts[a:z].astype("<i8").tobytes(), mass[k].tobytes(), lower[k].tobytes(), np.stack([r[i:j] - a, d[i:j], u[i:j], m[i:j]]).astype("<i4").tobytes()))
        names = ["bid", "bucket", "keys", "counts", "mass", "lower", "ask"]
        out = pd.DataFrame(rows, columns=names)
        sums = pd.DataFrame({"bid": [row.bid], "bucket": [-1], "keys": [np.diff(t.at).astype("<i8").tobytes()], "counts": [known_words.astype("<i8").tobytes()], "mass": [base_score.tobytes()], "lower": [score.tobytes()], "ask": [b""]})
        return pd.concat([sums, out], ignore_index=True)

    return run


def _weigh(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of contexts: exact backoff weights, and each batch's documents' sums of their logarithms."""
    pdf = pdf.sort_values("bid", ignore_index=True)
    keys = [unpack_keys(x) for x in pdf["keys"]]
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    every, back = np.unique(np.concatenate(keys), return_inverse=True)
    join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[name]])
    mass, lower = np.bincount(back, join("mass", "<f8"), len(every)), np.bincount(back, join("lower", "<f8"), len(every))
    count = np.zeros(len(every))
    count[back] = join("counts", "<i8")
    none = count - mass < 1e-9 * np.maximum(count, 1)  # nothing is discounted
    room = np.where(none, 1 / (count + 1), 1 - mass / np.maximum(count, 1))
    weight = np.log10(np.maximum(room, 1e-300)) - np.log10(np.maximum(1 - lower, 1e-300))
    shrink = np.where(none, np.log10(count / (count + 1), where=count > 0, out=np.zeros(len(every))), 0.0)
    rows = []
    for i, bid in enumerate(pdf.bid):
        k, d, u, m = np.frombuffer(pdf["ask"][i], "<i4").reshape(4, -1).astype(np.int64)
        which = back[at[i] : at[i + 1]][k]
        docs, place = np.unique(d, return_inverse=True)
        rows.append((bid, docs.astype("<i4").tobytes(), np.bincount(place, u * weight[which] + m * shrink[which], len(docs)).tobytes()))
    return pd.DataFrame(rows, columns=["bid", "docs", "sums"])


def _finish(totals: Totals):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        score = np.frombuffer(row["lower"], "<f8").copy()
        for docs, sums in zip(right.docs, right.sums, strict=True):
            score[np.frombuffer(docs, "<i4")] += np.frombuffer(sums, "<f8")
        ids = pd.array([None if x is None else x for x in row.ids], "Int64")
        return pd.DataFrame(
            {"doc_id": ids, "held_out": ~np.array(row.train, bool), "n_tokens": np.frombuffer(row["keys"], "<i8"), "n_known": np.frombuffer(row.counts, "<i8"), "train_tokens": totals.tokens, "base_score": np.frombuffer(row.mass, "<f8"), "score": score}
        )

    return run


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores every row's text; ``train`` tells which rows are learned from."""
    spark = docs.sparkSession
    ship(spark)
    buckets = partitions(spark)
    packed = stash(docs.select("doc_id", "train", "text").mapInArrow(_pack, "bid long, ids array<long>, train array<boolean>, lengths binary, data binary"))
    asked = packed.select("bid", "train", "lengths", "data").mapInArrow(_requests(buckets), "kind int, bucket int, bid long, keys binary, counts binary")
    told = stash(asked.groupBy("kind", "bucket").applyInPandas(_count, "bid long, kind int, bucket int, counts binary, owned binary, stats array<long>"))
    free_shuffles(spark)
    sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(KEEP + 3)]
    stats = {r["kind"]: [int(r[f"s{i}"] or 0) for i in range(KEEP + 3)] for r in told.where("bid = -1").groupBy("kind").agg(*sums).collect()}
    if not stats:
        return spark.createDataFrame([], OUT)
    documents = packed.select(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
    totals = Totals(stats[1][0], stats[1][1], documents, discounts(stats[2][2:]))
    kept = "bid long, bucket int, keys binary, counts binary, mass binary, lower binary, ask binary"
    answers = told.where("bid <> -1").select("bid", "kind", "bucket", "counts", "owned")
    state = packed.select("bid", "train", "lengths", "data")
    half = stash(state.groupBy("bid").cogroup(answers.groupBy("bid")).applyInPandas(_scores(totals, buckets), kept))
    free_shuffles(spark)
    weights = half.where("bucket >= 0").groupBy("bucket").applyInPandas(_weigh, "bid long, docs binary, sums binary")
    sums_ = half.where("bucket < 0").drop("bucket", "ask").join(packed.select("bid", "ids", "train"), "bid")
    return sums_.groupBy("bid").cogroup(weights.groupBy("bid")).applyInPandas(_finish(totals), OUT)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id")) != 1).alias("train"))
    out = score_documents(docs)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
