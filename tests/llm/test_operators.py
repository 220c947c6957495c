"""Each corpus operator against a brute-force version, and its odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocab=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def docs(spark, rows, schema=DOC):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], schema)


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, junk and empty texts."""
    base = words(300, 1)
    near = base.split()
    near[150] = "changed"
    passage = words(80, 2)
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, words(200, 3) + " " + passage), (5, passage + " " + words(200, 4)), (6, words(250, 5)), (7, None), (8, ""), (9, "  \n"), (10, "one two"), (10, "one two"), (11, "a " * 400)]
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i != 6 else None, None) for i, t in rows]


def test_near_classes(spark, corpus):
    from logloom.llm.near_dedup import keep_one, near_classes

    got = [(r.doc_id, r.class_id) for r in near_classes(docs(spark, corpus)).collect()]
    assert len(got) == len(corpus)
    classes = dict(got)
    assert classes[1] == classes[2] == classes[3] == 1
    assert all(classes[i] == i for i in (4, 5, 6, 7, 8, 10, 11))
    kept = keep_one(docs(spark, corpus).withColumn("node", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 9, 10, 11]
    assert near_classes(docs(spark, corpus).limit(0)).count() == 0


def test_signatures_are_unbiased():
    from logloom.llm.near_dedup import signatures

    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(1, 2**62, 300).astype(np.uint64))
    ca, cb = rng.integers(1, 9, 300), rng.integers(0, 9, 300)
    b = a[cb > 0]
    sig = signatures(np.concatenate([a, b]), np.concatenate([ca, cb[cb > 0]]), np.array([0, 300, 300 + len(b)]), 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(ca, cb).sum() / np.maximum(ca, cb).sum()) < 0.03


def test_compact_windows_cover_every_run_once():
    from logloom.llm.windows import compact_windows

    rng = np.random.default_rng(1)
    values = rng.integers(0, 40, 200).astype(np.uint64) << np.uint64(40)
    at, t = np.array([0, 3, 3, 90, 200]), 7
    windows = list(zip(*compact_windows(values, at, t), strict=True))
    for k in range(4):
        for a in range(at[k], at[k + 1]):
            for b in range(a + t - 1, at[k + 1]):
                hit = [w for w in windows if w[0] <= a <= w[1] <= b <= w[2]]
                assert len(hit) == 1 and hit[0][1] == a + int(np.argmin(values[a : b + 1]))


def test_substring_dedup(spark, corpus):
    from logloom.llm.substring_dedup import remove_passages, repeated_passages

    got = collections.defaultdict(list)
    for r in repeated_passages(docs(spark, corpus)).collect():
        got[r.doc_id].append((r.start_word, r.end_word, r.source_doc_id))
    assert set(got) == {2, 3, 5}
    assert got[2] == [(0, 300, 1)]
    assert got[5] == [(0, 80, 4)]
    assert min(s for s, _, _ in got[3]) == 0 and max(e for _, e, _ in got[3]) == 300
    left = {r.doc_id: r.text for r in remove_passages(docs(spark, corpus)).collect()}
    assert left[1] == corpus[0][1] and left[5] == " " + words(200, 4) and 2 not in left and left[7] is None
    assert repeated_passages(docs(spark, corpus).limit(0)).count() == 0


def brute_bytes(rows, length=400):
    count = collections.Counter(t.encode()[k : k + length] for _, t in rows for k in range(len(t.encode()) - length + 1))
    out = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark):
    from logloom.llm.suffix_dedup import remove_repeats

    r = random.Random(5)
    base = "".join(r.choice("abcdefg hé") for _ in range(2000))
    rows = [(0, ""), (1, "a" * 399), (2, "a" * 401), (3, "ab" * 500), (4, base[:700] + base[:700]), (5, base[:399]), (6, base[100:500])]
    for i in range(7, 60):
        a, n = r.randint(0, 1500), r.randint(300, 700)
        rows.append((i, "".join(r.choice("xyz") for _ in range(r.randint(0, 200))) + base[a : a + n] + "".join(r.choice("xyz") for _ in range(r.randint(0, 200)))))
    got = remove_repeats(spark.createDataFrame([*rows, (60, None)], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_bytes([*rows, (60, "")])
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    from logloom.llm.token_counts import count_tokens, vocabulary_path

    r = random.Random(1)
    parts = [*"abcABC'stre ve\t\n\x1c\x85\xa0éÉßΣςİ½٣日😀<|>{}-.1", "<|startoftext|>", "<|endoftext|>", "'ll", "aaaa", "ing", "the "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(600)] + [None, "", "a" * 3000, "!" * 2001]
    got = count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = [len(e.ids) for e in Tokenizer.from_file(vocabulary_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [(x.n_bytes, x.n_tokens, x.over_limit) for x in sorted(got)] == [(len((t or "").encode()), n, n > 2048) for t, n in zip(texts, want, strict=True)]


def test_language(spark):
    from logloom.llm.language import Scorer, marginals, predict, train

    r = random.Random(2)
    sound = {"aa": "tha ing ous er", "bb": "keit sch ung über", "cc": "ción ñue rr os"}
    rows = [(i, " ".join("".join(r.choices(sound[k].split(), k=3)) for _ in range(60)), k) for i, k in enumerate(list(sound) * 40)]
    df = docs(spark, rows)
    model = train(df.where("doc_id % 5 <> 0"))
    extra = docs(spark, [(1000, None), (1001, "123 ..."), (1002, ""), *rows]).withColumn("score", F.lit("x"))
    got = {x.doc_id: x for x in predict(extra, model, ["doc_id", "lang"]).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    held = [x for x in got.values() if x.lang and x.doc_id % 5 == 0]
    assert np.mean([x.lang == x.lang_pred for x in held]) > 0.95
    assert Scorer(train(df.limit(0))).predict(["hello"]) == (["und"], [0.0])
    rng = np.random.default_rng(0)
    n, t = np.array([1, 64, 65, 200]), rng.normal(size=(3, 3))
    s = rng.normal(size=(n.sum(), 3)) * 3
    p = marginals(s, n, t)
    for part, got_p in zip(np.split(s, np.cumsum(n)[:-1]), np.split(p, np.cumsum(n)[:-1]), strict=True):
        a, b = [part[0]], [np.zeros(3)]
        for i in range(1, len(part)):
            a.append(np.logaddexp.reduce(a[-1][:, None] + t, axis=0) + part[i])
        for i in range(len(part) - 1, 0, -1):
            b.append(np.logaddexp.reduce(t + (part[i] + b[-1])[None], axis=1))
        x = np.array(a) + np.array(b[::-1])
        x = np.exp(x - x.max(1, keepdims=True))
        assert np.allclose(got_p, x / x.sum(1, keepdims=True))


def test_katz(spark):
    from logloom.llm.katz import KEEP, discounts, score_documents
    from logloom.llm.language import fold

    rows = [(i, words(r, i, 30)) for i, r in enumerate(random.Random(3).choices(range(40), k=120))]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", "  ", "A a A a a", *["same text here now"] * 30])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", fold(F.col("doc_id")) != 1)
    got = {r.doc_id: r for r in score_documents(df).collect()}
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "</s>"]
    uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            h = "<s>"
            for w in token(t):
                uni[w] += 1
                bi[h, w] += 1
                ctx[h] += 1
                h = w
    n, v = uni.total(), len(uni)
    d = discounts([sum(c == r for c in bi.values()) for r in range(1, KEEP + 2)])
    base = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    kept = lambda c: c * (d[c] if c <= KEEP else 1)
    mass, low = collections.Counter(), collections.Counter()
    for (h, w), c in bi.items():
        mass[h] += kept(c)
        low[h] += base(w)

    def p(h, w):
        if not ctx[h]:
            return base(w)
        den = ctx[h] + (ctx[h] - mass[h] < 1e-9 * ctx[h])
        return kept(bi[h, w]) / den if bi[h, w] else (1 - mass[h] / den) / (1 - low[h]) * base(w)

    for h in list(ctx)[:10]:
        assert abs(sum(p(h, w) for w in uni) + p(h, "unknown") - 1) < 1e-9
    for i, t in rows:
        ws = token(t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(uni[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10(base(w)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(h, w)) for h, w in zip(["<s>", *ws], ws, strict=False)), rel_tol=1e-9)
    assert score_documents(df.limit(0)).count() == 0


def test_decontaminate(spark):
    from logloom.llm.decontaminate import contaminated, drop_contaminated

    items = [(i, words(25 + i, 100 + i, 10**6)) for i in range(6)] + [(6, None), (7, "")]
    half = items[1][1].split()
    half[::4] = ["other"] * len(half[::4])
    rows = [(i, words(150, i)) for i in range(20)]
    rows += [(100, words(90, 50) + " " + items[0][1] + ". " + words(70, 51)), (101, items[1][1].upper()), (102, " ".join(half)), (103, None), (104, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in contaminated(docs(spark, rows), bench).collect()}
    assert got[100, 0] == got[101, 1] == "verbatim"
    assert set(got) <= {(100, 0), (101, 1), (102, 1)}
    assert sorted(r.doc_id for r in drop_contaminated(docs(spark, rows), bench).collect() if r.doc_id >= 103 or r.doc_id < 100) == [*range(20), 103, 104]
    assert contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_nearest(spark):
    from logloom.llm.nearest import nearest

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, x[0].tolist()) for i in range(30)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (3004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {*range(0, 1200, 100), 2000}
    assert [v for v, _ in got[0]] == list(range(2000, 2010)) and [v for v, _ in got[2000]] == [0, *range(2001, 2010)]
    hit = 0
    for q in range(100, 1200, 100):
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len({v for v, _ in got[q]} & set(np.argsort(d)[:10].tolist()))
        assert all(math.isclose(s, d[v], rel_tol=1e-12) for v, s in got[q] if v < 1200)
    assert hit / 110 > 0.9
    assert nearest(df.limit(0), df).count() == 0


def test_licenses(spark):
    from logloom.llm.licenses import scan

    rows = [(1, "Text. Licensed under the Apache License, Version 2.0.\nmore"), (2, "THIS WORK IS LICENSED under the GNU General Public License, version 3. Released under the MIT License."), (3, None), (4, ""), (5, "a license of some kind"), (6, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: (r.licenses, r.n_matches) for r in scan(docs(spark, rows)).collect()}
    assert got == {1: ("Apache-2.0", 1), 2: ("GPL-3.0,MIT", 2), 6: ("CC-BY-NC-4.0", 1)}


def test_mix(spark):
    from logloom.llm.mixing import mix_documents

    rows = [(i, words(10 + i % 17, i), None, f"s{i % 4}" if i % 11 else None) for i in range(200)] + [(500, None, None, "s0"), (501, words(5, 1), None, "tiny"), (502, words(9, 9), None, "s1"), (502, words(9, 9), None, "s1")]
    df = docs(spark, rows).withColumn("size", F.lit(-1))
    out = mix_documents(df).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    per = out.groupby(out.source.fillna("~")).agg(taken=("taken", "sum"), size=("size", "sum"), target=("target", "first"))
    assert (abs(per.taken - per.target) <= 2).all() and (per.target <= 2 * per["size"]).all()
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6
    again = mix_documents(df.repartition(7)).toPandas()
    assert sorted(again.taken) == sorted(out.taken)
    assert mix_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", [10**6, 40])
def test_components(spark, monkeypatch, part):
    from logloom.llm import _graph

    monkeypatch.setattr(_graph, "PART", part)
    r = random.Random(7)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(100)]
    up = {x: x for e in edges for x in e}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.comp for x in _graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
