"""Suffix-array dedup: bytes under any 400-byte string that starts in two places.

Anchors make the work local: of every 400-byte string, the least of its 200-byte
substrings' hashes is an anchor, so two equal strings have equal anchors at equal
offsets.  Only anchors whose key occurs twice matter, which aggregates and joins
on keys find.  Where the whole context of an anchor (everything a 400-byte string
around it can reach) occurs twice, all its strings repeat.  The other anchors'
contexts are brought together by key and their suffixes sorted: a mergesort whose
comparisons find common extensions by binary search over prefix polynomial
hashes.  Neighbours in that order with a long enough extension are one class; a
range of offsets is halved until its class repeats as a whole or is alone.
Bytes are compared before a class counts, so a hash collision removes nothing.

Defined results: null counts as empty; texts under 400 bytes keep everything;
strings never cross texts; a text that stands in several rows loses everything
if it has 400 bytes or more; every row of the input gives a row; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship
from ._spark import discard, free_shuffles, partitions, stash, table, text_ids
from ._text import BYTE, STEP, U, column, flat, mix, slices
from .windows import run_minima

LENGTH = 400
ANCHOR = 200
BASE = U(0xF1357AEA2E62A9C5)
CHUNK = 1 << 20  # bytes of contexts that a task sorts at once
PIECE = 1 << 20  # bytes of text hashed at once
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        t = np.full(1 << max(12, int(n - 1).bit_length()), base, U)
        t[0] = 1
        _tables[base] = np.multiply.accumulate(t)
    return _tables[base][:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Prefix:
    """Polynomial hashes of all substrings of a byte array."""

    def __init__(self, buf: np.ndarray, base: np.uint64):
        n = len(buf)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(BYTE[buf] * _powers(int(base), n), out=self.sums[1:])
        self.back = _powers(_inverse(int(base)), n + 1)

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.sums[e] - self.sums[s]) * self.back[s]


def anchors(buf: np.ndarray, at: np.ndarray, length: int = LENGTH, k: int = ANCHOR):
    """(text, place in it, key, context hash) of the anchors of all texts of ``length`` bytes or more."""
    if len(buf) < length:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U), z.astype(U)
    one, two = Prefix(buf, STEP), Prefix(buf, BASE)
    n = len(buf) - k + 1
    h = mix((one.sums[k:] - one.sums[:n]) * one.back[:n])
    size = np.diff(at)
    # places at which k bytes of the same text start
    starts = np.concatenate([[0], np.cumsum(np.maximum(size - k + 1, 0))])
    own = np.repeat(np.arange(len(size)), np.diff(starts))
    place = np.arange(starts[-1]) - starts[own] + at[own]
    p, _ = run_minima(h[place], starts, length - k + 1)
    text, a = own[p], place[p]
    reach = length - k
    left, right = np.maximum(a - reach, at[text]), np.minimum(a + length, at[text + 1])
    context = mix(mix(two(left, a) + (a - left).astype(U) * BASE) ^ (two(a, right) + (right - a).astype(U) * STEP))
    return text, a - at[text], h[a], context


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=PIECE):
        buf, at = flat(column(batch, "text"))
        text, place, key, context = anchors(buf, at)
        if len(text):
            size = np.diff(at)[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), column(batch, "nid").take(pa.array(text)), pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32))],
                names=["key", "ctx", "nid", "pos", "size"],
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reach = LENGTH - ANCHOR
    for batch in slices(batches, most=PIECE):
        nid, text = column(batch, "nid").to_pylist(), column(batch, "text").to_pylist()
        rows: list[tuple] = []
        for i, wanted in enumerate(column(batch, "w").to_pylist()):
            data = text[i].encode()
            for x in wanted:
                left = max(0, x["pos"] - reach)
                rows.append((x["key"], nid[i], x["pos"], x["pos"] - left, data[left : x["pos"] + LENGTH]))
            if len(rows) > 5_000:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    key, nid, pos, left, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(nid, pa.int64()), pa.array(pos, pa.int32()), pa.array(left, pa.int32()), pa.array(data, pa.binary())], names=["key", "nid", "pos", "left", "data"])


class Suffixes:
    """Suffixes of short byte strings, compared by common extensions."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        self.buf, self.at = np.append(buf, np.uint8(0)), at
        self.prefix = Prefix(buf, BASE)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of places a and b, ``most`` bytes at the most."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.prefix(a, a + mid) == self.prefix(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        n = self.common(a, b, most)
        return (n < most) & (self.buf[np.minimum(a + n, len(self.buf) - 1)] < self.buf[np.minimum(b + n, len(self.buf) - 1)])

    def sort(self, start: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
        """Order of the suffixes within each group (groups are contiguous), by ``most`` bytes.

        Bottom-up mergesort of all groups at once: an element's place after a merge
        is its own plus the number of smaller ones in the other run, found by
        binary search with hash-compared suffixes.
        """
        n = len(start)
        order = np.arange(n)
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        count = np.diff(np.append(edge, n))
        base, size = np.repeat(edge, count), np.repeat(count, count)
        width, limit = 1, int(count.max(initial=0))
        while width < limit:
            i = np.flatnonzero(size > width)  # groups that one run fills are done
            rel = i - base[i]
            run = rel // width
            mate = (run ^ 1) * width
            mate_n = np.clip(size[i] - mate, 0, width)
            low, high = np.zeros(len(i), np.int64), mate_n.copy()
            me = start[order[i]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                other = start[order[base[i[open_]] + mate[open_] + mid]]
                mine = me[open_]
                cap = np.full(len(open_), most, np.int64)
                right = run[open_] % 2 == 1  # of equal ones, the left run's come first
                before = np.where(right, ~self.less(mine, other, cap), self.less(other, mine, cap))
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            pair = run - run % 2
            target = base[i] + pair * width + (rel - run * width) + low
            moved = order.copy()
            moved[target] = order[i]
            order = moved
            width *= 2
        return order


def repeated(data: list[bytes], left: np.ndarray, group: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last offset before the anchor) of ranges of strings that another context of the group has.

    Contexts are sorted by group; the string at offset d starts d bytes before the anchor.
    """
    at = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    buf = np.frombuffer(b"".join(data), np.uint8)
    sx = Suffixes(buf, at)
    reach = length - k
    width = 1 << max(0, (reach.bit_length() - 1))
    lows = np.arange(0, reach + 1, width)
    node = np.repeat(np.arange(len(data)), len(lows))
    low = np.tile(lows, len(data))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(node):
        core = length - width + 1
        high = low + width - 1
        begin = at[node] + left[node] - low  # the core runs from here, if it is all there
        has = (low <= left[node]) & (begin + core <= at[node + 1])
        if width > 1:
            # a core cut off by the text's ends says nothing of the strings inside
            cut = np.flatnonzero(~has & (low <= left[node]))
        else:
            cut = np.zeros(0, np.int64)
        i = np.flatnonzero(has)
        order = np.lexsort((low[i], group[node[i]]))
        i = i[order]
        code = np.cumsum(np.append(0, (group[node[i]][1:] != group[node[i]][:-1]) | (low[i][1:] != low[i][:-1]))) if len(i) else np.zeros(0, np.int64)
        i = i[sx.sort(begin[i], code, core)]
        same = np.zeros(max(0, len(i) - 1), bool)
        if len(i) > 1:
            near = np.flatnonzero(code[1:] == code[:-1])
            b = begin[i]
            same[near] = sx.common(b[near], b[near + 1], np.full(len(near), core)) >= core
            sure = np.flatnonzero(same)
            for s in range(0, len(sure), 4096):  # the bytes themselves
                p = sure[s : s + 4096]
                span = np.arange(core)
                same[p] = (buf[b[p][:, None] + span] == buf[b[p + 1][:, None] + span]).all(1)
        shared = np.append(same, False) | np.append(False, same)
        klass = np.cumsum(np.append(True, ~same)) if len(i) else np.zeros(0, np.int64)
        i, klass = i[shared[: len(i)]], klass[: len(i)][shared[: len(i)]]
        if width == 1:
            out.append((node[i], low[i], low[i]))
            break
        # does the whole range repeat?
        first = at[node[i]] + left[node[i]] - high[i]
        last = at[node[i]] + left[node[i]] - low[i] + length
        full = (high[i] <= left[node[i]]) & (last <= at[node[i] + 1])
        h = np.where(full, mix(sx.prefix(np.where(full, first, 0), np.where(full, last, 0)) ^ (klass.astype(U) * STEP)), mix(np.arange(len(i)).astype(U) + BASE))
        _, one, back, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        whole = full & (times[back] > 1)
        j = i[whole]
        out.append((node[j], low[j], high[j]))
        # the others of a class still need what repeats as a whole as a partner
        stay = ~whole
        stay[one[np.isin(klass[one], klass[~whole])]] = True
        rest = np.concatenate([i[stay], cut])
        width //= 2
        node, low = np.repeat(node[rest], 2), np.repeat(low[rest], 2)
        low[1::2] += width
        keep = low <= reach
        node, low = node[keep], low[keep]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["key", "nid", "pos"], ignore_index=True)
    key = pdf.key.to_numpy()
    size = np.cumsum(pdf.data.map(len).to_numpy())
    edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    out, i = [], 0
    while i < len(edge) - 1:
        base = size[edge[i]] - len(pdf.data.iloc[edge[i]])
        j = i + 1
        while j < len(edge) - 1 and size[edge[j + 1] - 1] - base <= CHUNK:
            j += 1
        part = pdf.iloc[edge[i] : edge[j]]
        c, first, last = repeated(part.data.tolist(), part.left.to_numpy(np.int64), part.key.to_numpy())
        pos = part.pos.to_numpy(np.int64)[c]
        out.append(pd.DataFrame({"nid": part.nid.to_numpy()[c], "s": pos - last, "e": pos - first + LENGTH}))
        i = j
    return pd.concat(out, ignore_index=True)


def covered(docs: DataFrame, ids: Column) -> DataFrame:
    """(nid, spans): of each distinct text, the byte ranges that repeated strings cover, not merged."""
    spark = docs.sparkSession
    seen = docs.where(f"octet_length(text) >= {LENGTH}").select("text", ids.alias("nid"))
    found = stash(seen.mapInArrow(_anchors, "key long, ctx long, nid long, pos int, size int"))
    place = F.struct("nid", "pos")
    twice = found.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("key")
    # copies of a text give equal rows; dealt anew, as one key may have most of them
    same = found.join(twice, "key").repartition("nid", "pos").groupBy("key", "ctx", "nid", "pos")
    hits = stash(same.agg(F.first("size").alias("size")))
    discard(found)
    free_shuffles(spark)
    kinds = hits.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(place).alias("rep"))
    full = hits.join(kinds.where("n > 1").select("key", "ctx"), ["key", "ctx"])
    spans = full.select("nid", F.greatest(F.lit(0), F.col("pos") - (LENGTH - ANCHOR)).cast("long").alias("s"), F.least(F.col("size"), F.col("pos") + LENGTH).cast("long").alias("e"))
    open_keys = kinds.where("n = 1").select("key").distinct()
    need = kinds.join(open_keys, "key", "left_semi").select("key", "rep.nid", "rep.pos")
    wanted = stash(need.groupBy("nid").agg(F.collect_list(F.struct("key", "pos")).alias("w")))
    texts = seen.join(wanted, "nid").groupBy("nid").agg(F.first("text").alias("text"), F.first("w").alias("w"))
    contexts = texts.mapInArrow(_contexts, "key long, nid long, pos int, left int, data binary")
    buckets = 4 * partitions(spark)
    part = contexts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(_bucket, "nid long, s long, e long")
    every = stash(spans.unionByName(part))
    discard(hits)
    discard(wanted)
    free_shuffles(spark)
    return every.groupBy("nid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        many = column(batch, "many").to_pylist()
        spans = column(batch, "spans")
        for i, text in enumerate(column(batch, "text").to_pylist()):
            data = (text or "").encode()
            if many[i] and len(data) >= LENGTH:
                merged = [(0, len(data))]
            else:
                merged = []
                for x in sorted((x["s"], x["e"]) for x in spans[i].as_py() or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], x[1]))
                    else:
                        merged.append(x)
            kept, at = hashlib.sha256(), 0
            for s, e in merged:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            rows.append((len(data), sum(e - s for s, e in merged), len(merged), kept.hexdigest()))
        n, gone, runs, sha = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    ship(docs.sparkSession)
    ids = text_ids(docs)
    spans = covered(docs, ids)
    tagged = docs.select("doc_id", "text", F.when(F.octet_length("text") >= LENGTH, ids).alias("nid"))
    copies = tagged.where("nid IS NOT NULL").groupBy("nid").count().where("count > 1").select("nid", F.lit(True).alias("many"))
    per = spans.join(copies, "nid", "full")
    met = tagged.join(per, "nid", "left").select("doc_id", "text", F.coalesce("many", F.lit(False)).alias("many"), "spans")
    return met.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
