"""Language identification with a linear-chain conditional random field over words.

States are the languages of the labelled rows.  A word's emission score sums the
weights of its hashed features: the word itself (lexicon), prefixes and suffixes
of one to three characters, and character bigrams and trigrams.  Transitions are
learned with them.  Training fits a bounded sample of labelled rows (SAMPLE a
language, whole texts, chosen by a hash) in one task, by RUNS runs of words from
one or two languages so that switches are seen; the driver gets the model only.
Prediction runs forward-backward over every word of every text.

Long texts are no sequential loop: the chain is cut into blocks of equal length,
each block's transfer matrix is worked out for all blocks at once, the block ends
are chained, and the marginals inside all blocks follow at once.

Defined results: null texts and texts without a letter get ``und`` with score 0;
an empty text likewise; with no labelled row at all every text is ``und``; ties
go to the language that comes first by code point; other columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._ship import ship
from ._spark import cut, table
from ._text import column, slices

DIM = 1 << 18
SAMPLE = 1500  # labelled texts per language that training may read
RUNS = 6000  # runs of words that an epoch of training takes at the most
FEW_LANGUAGES = 100_000  # rows of the table of languages that may be broadcast
BLOCK = 64
NO_LANGUAGE = "und"
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")  # and numbers without digits, which split_odd takes out


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; null counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


@lru_cache(1)
def _letters() -> re.Pattern[str]:
    odd = [i for i in range(sys.maxunicode + 1) if chr(i).isalnum() and not chr(i).isalpha() and not chr(i).isdecimal()]
    letter = rf"[^\W\d_{''.join(map(chr, odd))}]"
    return re.compile(rf"{letter}+(?:['’]{letter}+)*")


def split_odd(found: set[str]) -> dict[str, list[str]]:
    """Those of the words that hold numbers without digits, such as superscripts, with what is left of them: runs of letters."""
    parts = {w: _letters().findall(w) for w in found if not w.isascii()}
    return {w: p for w, p in parts.items() if p != [w]}


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids of each word, flat, and n + 1 offsets."""
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(n)
    start = end - n
    own = np.repeat(np.arange(len(words)), n)
    place = np.arange(len(chars)) - start[own]
    rest = n[own] - place
    pad = np.concatenate([chars, np.zeros(3, np.uint32)])
    c0, c1, c2 = pad[:-3], pad[1:-2], pad[2:-1]
    one = _mix32(c0 + np.uint32(0x1234567))
    two = _mix32(one + c1 * np.uint32(0x9E3779B1))
    three = _mix32(two + c2 * np.uint32(0x85EBCA77))
    ids, of = [], []

    def add(kind: int, h: np.ndarray, who: np.ndarray) -> None:
        ids.append(_mix32(h + np.uint32(kind * 0x3C6EF372 & 0xFFFFFFFF)) % np.uint32(DIM))
        of.append(who)

    word = np.zeros(len(words), np.uint32)
    if len(chars):
        word = np.add.reduceat(_mix32(c0 + (place.astype(np.uint32) << np.uint32(16))), start)
    add(1, word, np.arange(len(words)))
    for kind, h, k in ((2, one, 1), (3, two, 2), (4, three, 3)):
        whole = rest >= k
        first, last = whole & (place == 0), rest == k
        add(kind, h[first], own[first])
        add(kind + 4, h[last], own[last])
        if k > 1:
            add(kind + 8, h[whole], own[whole])
    ids, of = np.concatenate(ids), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return ids[order].astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIM x languages
    transitions: np.ndarray  # languages x languages, log scores

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log scores, one row a word."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for i in range(0, len(words), 20_000):
            ids, at = features(words[i : i + 20_000])
            out[i : i + 20_000] = np.add.reduceat(self.weights[ids], at[:-1])
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior of every word's state by forward-backward, texts after one another.

    scores: words x states; lengths: words of each text, none of them 0.  Exact
    for any length.  A text's first block is padded in front, where the forward
    pass starts anew and the backward pass is not read.
    """
    s = scores.shape[1]
    e = np.exp(scores.astype(np.float64) - scores.max(1, keepdims=True))
    t = np.exp(transitions - transitions.max()).astype(np.float64)
    blocks = -(-lengths // block)
    n = int(blocks.sum())
    first = np.cumsum(blocks) - blocks
    pad = blocks * block - lengths
    own = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(e)) - (np.cumsum(lengths) - lengths)[own] + pad[own]
    row, col = first[own] + place // block, place % block
    em = np.ones((block, s, n))
    em[col, :, row] = e
    later = np.ones(n, bool)
    later[first] = False
    begins = np.full(n, -1)
    begins[first] = pad
    # what a block does to a message, for the blocks that have one before them
    sub = np.ascontiguousarray(em[:, :, later])
    through = np.repeat(np.eye(s)[:, :, None], sub.shape[2], 2)
    for i in range(block):
        through = np.matmul(t.T, through)
        through *= sub[i]
        if i % 4 == 3:
            through /= through.sum((0, 1))
    at_later = np.cumsum(later) - 1
    # the first block's own message
    a = np.ones((s, len(first)))
    head = em[:, :, first]
    for i in range(block):
        a = np.where(pad == i, 1.0, t.T @ a) * head[i]
        a /= a.sum(0)
    enter, leave = np.ones((s, n)), np.ones((s, n))
    most = int(blocks.max()) if len(blocks) else 0
    for k in range(1, most):
        go = blocks > k
        m = a[:, go] if k == 1 else np.einsum("an,abn->bn", enter[:, first[go] + k - 1], through[:, :, at_later[first[go] + k - 1]])
        enter[:, first[go] + k] = m / m.sum(0)
    for k in range(most - 2, -1, -1):
        at = first[blocks > k + 1] + k
        m = np.einsum("abn,bn->an", through[:, :, at_later[at + 1]], leave[:, at + 1])
        leave[:, at] = m / m.sum(0)
    forward, a = np.empty((block, s, n)), enter
    for i in range(block):
        a = np.matmul(t.T, a)
        here = begins == i
        if here.any():
            a[:, here] = 1.0
        a *= em[i]
        a /= a.sum(0)
        forward[i] = a
    b = leave
    for i in range(block - 1, -1, -1):
        forward[i] *= b
        b = np.matmul(t, em[i] * b)
        b /= b.sum(0)
    p = forward[col, :, row]
    return p / p.sum(1, keepdims=True)


def code(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], dict[str, np.ndarray]]:
    """The words of labelled texts, and each language's texts as the words' numbers."""
    number: dict[str, int] = {}
    found: dict[str, list[np.ndarray]] = {}
    for batch in slices(batches):
        for text, lang in zip(column(batch, "text").to_pylist(), column(batch, "lang").to_pylist(), strict=True):
            some = WORD.findall(text.lower())
            if odd := split_odd(set(some)):
                some = [p for w in some for p in odd.get(w, (w,))]
            found.setdefault(lang, []).append(np.fromiter((number.setdefault(w, len(number)) for w in some), np.int32, len(some)))
    return list(number), {lang: np.concatenate(x) for lang, x in found.items()}


def fit(words: list[str], texts: dict[str, np.ndarray], epochs: int = 3, rate: float = 0.3, length: int = 32, seed: int = 7) -> Model:
    """AdaGrad on the conditional log-likelihood of runs of ``length`` words.

    A third of the runs join two texts' words, so that transitions see switches.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(texts)
    coded = [texts[x] for x in languages]
    ok = [i for i, c in enumerate(coded) if len(c)]
    k = len(languages)
    if not ok:
        return Model(languages, np.zeros((DIM, k), np.float32), np.zeros((k, k)))
    w, g = np.zeros((DIM, k)), np.full((DIM, k), 1e-3)
    t, gt = np.zeros((k, k)), np.full((k, k), 1e-3)
    runs = min(RUNS, max(len(c) for c in coded) * len(ok) // length + 1)
    for _ in range(epochs):
        for _ in range(0, runs, 256):
            lang = rng.choice(ok, 256)
            other = np.where(rng.random(256) < 1 / 3, rng.choice(ok, 256), lang)
            turn = rng.integers(1, length, 256)
            y = np.where(np.arange(length) < turn[:, None], lang[:, None], other[:, None])
            x = np.empty((256, length), np.int64)
            for i in range(k):
                here = y == i
                if here.any():
                    rows = np.flatnonzero(here.any(1))
                    for r in rows:
                        n = int(here[r].sum())
                        s = int(rng.integers(0, max(1, len(coded[i]) - n)))
                        x[r, here[r]] = np.resize(coded[i][s : s + n], n)
            seen, back = np.unique(x, return_inverse=True)
            f, at = features([words[v] for v in seen.tolist()])
            own = np.repeat(np.arange(len(seen)), np.diff(at))
            em = np.zeros((len(seen), k))
            np.add.at(em, own, w[f])
            scores = em[back.reshape(x.shape)]
            # forward-backward in logs over the batch
            e, tr = np.exp(scores - scores.max(-1, keepdims=True)), np.exp(t)
            al, be = np.empty_like(e), np.empty_like(e)
            al[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            for i in range(1, length):
                a = (al[:, i - 1] @ tr) * e[:, i]
                al[:, i] = a / a.sum(1, keepdims=True)
            be[:, -1] = 1
            for i in range(length - 2, -1, -1):
                b = (e[:, i + 1] * be[:, i + 1]) @ tr.T
                be[:, i] = b / b.sum(1, keepdims=True)
            p = al * be
            p /= p.sum(-1, keepdims=True)
            pair = al[:, :-1, :, None] * tr * (e * be)[:, 1:, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            truth = np.zeros((k, k))
            np.add.at(truth, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            dt = (pair.sum((0, 1)) - truth) / 256
            err = p.copy()
            np.put_along_axis(err, y[..., None], np.take_along_axis(err, y[..., None], -1) - 1, -1)
            dw = np.zeros((len(seen), k))
            np.add.at(dw, back.ravel(), err.reshape(-1, k))
            df = np.zeros((DIM, k))
            np.add.at(df, f, dw[own])
            hit = np.unique(f)
            step = df[hit] / 256
            g[hit] += step**2
            w[hit] -= rate * step / np.sqrt(g[hit])
            gt += dt**2
            t -= rate * dt / np.sqrt(gt)
    return Model(languages, w.astype(np.float32), t)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = fit(*code(batches))
    cols = [pa.array([m.languages], pa.list_(pa.string())), pa.array([m.weights.astype("<f4").tobytes()], pa.binary()), pa.array([m.transitions.astype("<f8").tobytes()], pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, names=["languages", "weights", "transitions"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows a language, chosen by a hash of the text.

    ``docs`` holds the rows that may be learned from: columns text and lang.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", F.xxhash64("text").alias("h"))
    counts = cut(keyed.groupBy("lang").agg(F.count("*").alias("n")))  # one row a language
    n = counts.count()
    # a share that leaves somewhat more than the sample, so that few rows are put in order
    share = counts.select(F.col("lang").alias("of"), (F.least(F.lit(1.0), (1.5 * sample + 20) / F.col("n")) * (1 << 30)).cast("long").alias("upto"))
    some = keyed.join(F.broadcast(share) if n <= FEW_LANGUAGES else share, F.col("lang") == F.col("of")).where(F.pmod("h", F.lit(1 << 30)) < F.col("upto"))
    w = Window.partitionBy("lang").orderBy("h", "text")
    few = some.select("text", "lang", "h", F.row_number().over(w).alias("r")).where(F.col("r") <= sample)
    got = few.repartition(1).sortWithinPartitions("lang", "h", "text").mapInArrow(_fit, "languages array<string>, weights binary, transitions binary").collect()
    if not got or not got[0]["languages"]:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros((0, 0)))
    k = len(got[0]["languages"])
    return Model(list(got[0]["languages"]), np.frombuffer(got[0]["weights"], "<f4").reshape(DIM, k), np.frombuffer(got[0]["transitions"], "<f8").reshape(k, k))


class Scorer:
    """Predicts the language of whole texts; keeps emissions of words it has met."""

    def __init__(self, model: Model, cache: int = 200_000):
        self.model, self.most = model, cache
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        lists = [WORD.findall(t.lower()) for t in texts]
        if len(self.index) > self.most:
            self.index, self.table = {}, self.table[:0]
        fresh = set().union(*lists).difference(self.index)
        if odd := split_odd(fresh):
            lists = [[p for w in x for p in odd.get(w, (w,))] for x in lists]
            fresh = set().union(*lists).difference(self.index)
        if fresh := list(fresh):
            n = len(self.index)
            self.index.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            self.table = np.concatenate([self.table, self.model.emissions(fresh)])
        n = np.array([len(x) for x in lists], np.int64)
        langs, scores = [NO_LANGUAGE] * len(texts), [0.0] * len(texts)
        some = np.flatnonzero(n)
        if not len(some) or not self.model.languages:
            return langs, scores
        look = self.index.__getitem__
        ids = np.fromiter((look(w) for i in some for w in lists[i]), np.int64, int(n.sum()))
        p = marginals(self.table[ids], n[some], self.model.transitions)
        share = np.add.reduceat(p, np.cumsum(n[some]) - n[some]) / n[some][:, None]
        best = share.argmax(1)
        for i, b, x in zip(some, best, share.max(1), strict=True):
            langs[i], scores[i] = self.model.languages[b], float(min(1.0, x))
        return langs, scores


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Adds lang_pred and score to the kept columns."""
    from pyspark.sql.types import DoubleType, StringType

    ship(docs.sparkSession)
    # the model's size is fixed by DIM and the number of languages
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    schema = docs.select(kept).schema.add("lang_pred", StringType()).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, most=1 << 20):
            langs, scores = scorer.predict([t or "" for t in column(batch, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(F.col("doc_id")) != 0))
    out = predict(docs, model, ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
