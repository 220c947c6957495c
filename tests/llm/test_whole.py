"""Cases that an earlier cut of candidates lost."""

import random

import numpy as np

from logloom.llm.windows import run_minima


def test_near_copies_behind_other_first_texts(spark):
    """Every band that two near copies share starts with a text that is like neither."""
    from logloom.llm.near_dedup import near_classes

    rng = random.Random(5)
    base = [f"w{i}" for i in range(1000)]

    def changed(n):
        out = list(base)
        for i in rng.sample(range(0, 1000, 5), n):
            out[i] = f"x{rng.random()}"
        return " ".join(out)

    texts = [changed(28) for _ in range(60)] + [" ".join(base), changed(18)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_classes(docs).collect()}
    assert got[61] == 60
    assert all(got[i] == i for i in range(60))


def test_cells_hold_every_similar_pair(spark, monkeypatch):
    """Blocks of a band lose no pair that may be similar, and each bound is an upper one."""
    from logloom.llm import near_dedup as nd

    monkeypatch.setattr(nd, "BLOCK", 4)
    rng = random.Random(6)
    texts = []
    for _ in range(4):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(60, 200))]
        texts += [" ".join(base[: len(base) - cut]) for cut in range(0, 30, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = docs.select(nd.node_of(docs.text).alias("node"), "text").distinct()
    m = seen.selectExpr("1L AS band", "node", "node AS comp")
    keys = seen.selectExpr("node", "array(1L, 2L) AS keys")
    got = {(bytes(r.a), bytes(r.b)) for r in nd._cells(m, keys, seen, 0.8, trees=False).collect()}
    pairs = seen.withColumnsRenamed({"node": "a", "text": "ta"}).crossJoin(seen.withColumnsRenamed({"node": "b", "text": "tb"})).where("a < b")
    want = {(bytes(r.a), bytes(r.b)) for r in pairs.mapInArrow(nd._verify, "a binary, b binary, j double").where("j >= 0.8").collect()}
    assert want and want == got
    trees = {(bytes(r.a), bytes(r.b)) for r in nd._cells(m, keys, seen, 0.8).collect()}
    assert trees <= want and len(trees) < len(want)
    part = lambda edges: {frozenset(c) for c in _components(edges)}
    assert part(trees) == part(want)
    later = seen.selectExpr("2L AS band", "node", "node AS comp")
    assert nd._cells(later, keys, seen, 0.8).count() == 0


def _components(edges):
    out = {}
    for a, b in edges:
        both = out.get(a, {a}) | out.get(b, {b})
        for x in both:
            out[x] = both
    return out.values()


def test_passages_behind_false_leaders(spark):
    """Every signature of a passage two texts share has an earlier text with no passage."""
    from logloom.llm.substring_dedup import repeated_passages

    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]

    def around(p):
        return " ".join([f"u{rng.random()}" for _ in range(60)] + p + [f"u{rng.random()}" for _ in range(60)])

    def spoilt():
        out, first = list(passage), rng.randrange(5, 12)
        for i in range(first, 60, 12):
            out[i] = f"x{rng.random()}"
        return out

    texts = [around(spoilt()) for _ in range(60)] + [around(passage), around(passage)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in repeated_passages(docs).where("doc_id >= 60").collect()]
    assert got == [(61, 60, 120, 60)]


def test_passages_at_other_offsets():
    """Passages next to one another in b that are swapped, apart or behind a repeated line in a."""
    import numpy as np

    from logloom.llm.substring_dedup import passages_of

    def found(a, b):
        words = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
        five = lambda t: np.array([hash(tuple(words[w] for w in t[i : i + 5])) for i in range(len(t) - 4)], np.int64)
        x, y = five(a), five(b)
        return sorted(passages_of(x, y, [(i, 0, len(x) - 1, 0, len(y) - 1) for i in range(2)], 50))

    one, two, long = ([f"{c}{i}" for i in range(n)] for c, n in (("p", 50), ("q", 50), ("r", 150)))
    gap = [f"g{i}" for i in range(100)]
    assert found(two + gap + one, one + two) == [(0, 50, 150, 200), (50, 100, 0, 50)]
    assert found(one + gap + two, one + two) == [(0, 50, 0, 50), (50, 100, 150, 200)]
    assert found(long + gap + one, one + long) == [(0, 50, 250, 300), (50, 200, 0, 150)]
    assert found(one[:10] + gap + one + gap + two, one + two) == [(0, 50, 110, 160), (50, 100, 260, 310)]
    assert found(one, one) == [(0, 50, 0, 50)]


def test_minima_of_texts_that_meet_alike():
    """A text's first run may have the value and place that the last run of the text before had."""
    r = np.random.default_rng(2)
    for _ in range(300):
        at = np.concatenate([[0], np.cumsum(r.integers(0, 30, int(r.integers(1, 6))))])
        v, t = r.integers(0, 5, int(at[-1])).astype(np.uint64) << np.uint64(30), int(r.integers(1, 8))
        want = {int(i + np.argmin(v[i : i + t])) for a, b in zip(at[:-1], at[1:], strict=True) for i in range(a, b - t + 1)}
        assert run_minima(v, at, t)[0].tolist() == sorted(want)
    v = np.tile(np.array([5, 1, 7], np.uint64) << np.uint64(30), 2)
    assert run_minima(v, np.array([0, 3, 6]), 3)[0].tolist() == [1, 4]


def test_windows_meet_all_earlier_ones_in_few_turns(spark, monkeypatch):
    """Cells of few windows, in several turns, give what one cell gives; windows that have met all texts are not compared again."""
    from logloom.llm import substring_dedup as sd

    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]

    def around(p):
        return " ".join([f"u{rng.random()}" for _ in range(60)] + p + [f"u{rng.random()}" for _ in range(60)])

    def spoilt(first):
        return [f"x{rng.random()}" if i % 12 == first else w for i, w in enumerate(passage)]

    texts = [around(spoilt(5 + i % 7)) for i in range(60)] + [around(passage), around(passage)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared, turns = [], []
    whole, laid = sd._next_earlier, sd._contents

    def counted(*args):
        compared.append(args)
        return whole(*args)

    def dealt(*args):
        turns.append(args)
        return laid(*args)

    monkeypatch.setattr(sd, "_next_earlier", counted)
    monkeypatch.setattr(sd, "_contents", dealt)

    def found():
        return [tuple(r) for r in sd.repeated_passages(docs).where("doc_id >= 60").collect()]

    want = [(61, 60, 120, 60)]
    assert found() == want
    assert len(compared) == 1 and turns == [(0, 1)]
    turns.clear()
    monkeypatch.setattr(sd, "BLOCK", 5)
    monkeypatch.setattr(sd, "PLACES", 50)
    assert found() == want
    assert len(turns) > 1 and len(compared) == 2, (turns, len(compared))


def test_shared_places():
    from logloom.llm.substring_dedup import shared_places

    rng = np.random.default_rng(10)
    late, early = ([rng.integers(0, 300, rng.integers(1, 90)).astype("<u2") for _ in range(n)] for n in (23, 31))
    assert (shared_places(late, early) == [[np.isin(x, y).sum() for y in early] for x in late]).all()


def test_runs_around():
    from logloom.llm.substring_dedup import best_runs, runs_around

    rng = np.random.default_rng(3)
    rows = [np.repeat(rng.random(40) < 0.6, rng.integers(1, rng.choice([4, 12, 40]), 40))[: rng.integers(1, 300)] for _ in range(800)]
    p = np.array([rng.integers(len(x)) for x in rows])
    got = runs_around(np.concatenate(rows), np.array([len(x) for x in rows]), p, 6)
    want = [any(a <= k < b for a, b in best_runs(x, 6, 8)) for x, k in zip(rows, p, strict=True)]
    assert got.tolist() == want and 100 < sum(want) < 700


def test_cells_give_the_same_together_and_alone(monkeypatch):
    """Windows compared in pooled small cells, in large cells, and over batch edges; against best_runs for every pair."""
    import pyarrow as pa

    from logloom.llm import substring_dedup as sd

    rng = np.random.default_rng(4)
    t, most, need = 12, 3, 11
    rows = []
    for key in range(12):
        line, base = rng.integers(0, 1 << 16, 5), rng.integers(0, 1 << 16, 60)
        for nid in range(int(rng.integers(2, 40))):
            x = base.copy() if rng.random() < 0.5 else rng.integers(0, 1 << 16, 60)
            x[rng.random(60) < 0.03] = 7
            x[20:25] = line
            late = bool(rng.random() < 0.7)
            rows.append({"key": key, "salt": 0, "late": late, "early": True, "doc_id": int(rng.integers(0, 9)), "nid": nid, "l": 3, "p": 25, "r": 62, "sd": sd.FIRST, "sn": sd.FIRST, "data": x.astype("<u2").tobytes()})
    rows.sort(key=lambda x: (x["key"], not x["late"], x["doc_id"], x["nid"]))
    kinds = {"key": pa.int64(), "salt": pa.int32(), "late": pa.bool_(), "early": pa.bool_(), "doc_id": pa.int64(), "nid": pa.int64(), "l": pa.int32(), "p": pa.int32(), "r": pa.int32(), "sd": pa.int64(), "sn": pa.int64(), "data": pa.binary()}
    table = pa.Table.from_pylist(rows, pa.schema(list(kinds.items())))
    want = set()
    for x in rows:
        met, hits = np.frombuffer(x["data"], "<u2"), []
        for y in rows:
            if x["late"] and y["key"] == x["key"] and (y["doc_id"], y["nid"]) < (x["doc_id"], x["nid"]):
                same = np.isin(met, np.frombuffer(y["data"], "<u2"))
                if same.sum() >= need and any(a <= 22 < b for a, b in sd.best_runs(same, t, sd.SHARE / (1 - sd.SHARE))):
                    hits.append((y["doc_id"], y["nid"]))
        want |= {(x["key"], x["nid"], nid, k) for k, (_, nid) in enumerate(sorted(hits)[:most])}
    assert len(want) > 100
    for small, early, size in ((64, 512, 1000), (64, 512, 7), (1, 4, 9), (8, 3, 1000)):
        monkeypatch.setattr(sd, "SMALL", small)
        monkeypatch.setattr(sd, "EARLY", early)
        monkeypatch.setattr(sd, "RARE", 4)
        got = [r for b in sd._compare(t, most)(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert {(r["key"], r["nid"], r["a"], r["k"]) for r in got} == want and len(got) == len(want)


def test_texts_are_exchanged_once(spark):
    """Joins on a table that is dealt out by its key leave it where it is; the catalog forgets it."""
    from logloom.llm._spark import discard, stash_by

    texts = stash_by(spark.range(1000).selectExpr("id AS nid", "repeat('x', 100) AS text"), "nid")
    assert not spark.catalog.listTables()
    some = spark.range(2000).selectExpr("id % 500 AS nid").hint("merge")
    met = texts.join(some, "nid")
    assert met.count() == 2000
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and texts.count() == 1000
    discard(texts)
