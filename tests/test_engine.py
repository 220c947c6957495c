"""Operators of the log engine on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.functions import strategies as st
from logloom.functions.timestamps import epoch_auto_ns, format_rfc3339, parse, parse_offset
from logloom.operators import analytics as an
from logloom.operators import framing, infer, store
from logloom.plans import definitions, pipeline
from logloom.sources import sinks
from logloom.streaming import syslog

RECEIPT = 1788523200 * 10**9  # 2026-09-04T12:00:00Z


# -- timestamps ---------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "spec", "want", "policies"),
    [
        ("2024-02-29 23:10:05 -0330", "auto", "2024-03-01T02:40:05.000Z", ()),
        ("Mar  1 06:07:08", "syslog", "2024-03-01T06:07:08.000Z", ("year_assumed", "tz_assumed")),
        ("Apr  2 01:02:03", "syslog", "2023-04-02T01:02:03.000Z", ("year_assumed", "tz_assumed")),
        ("[29/Feb/2024:06:07:08 +0100]", "auto", "2024-02-29T05:07:08.000Z", ()),
        ("2024-03-01 12:00:00 CST", "auto", "2024-03-01T18:00:00.000Z", ("zone_name_ambiguous",)),
        ("2024-03-01 12:00:00 QQQ", "auto", "2024-03-01T12:00:00.000Z", ("zone_name_unknown",)),
        ("1709283661250", "auto", "2024-03-01T09:01:01.250Z", ()),
        ("2024-03-01 12:30:00 am", "%Y-%m-%d %I:%M:%S %p", "2024-03-01T00:30:00.000Z", ("tz_assumed",)),
        ("2024-061 04:05:06", "%Y-%j %H:%M:%S", "2024-03-01T04:05:06.000Z", ("tz_assumed",)),
        ("2016-12-31T23:59:60Z", "rfc3339", "2017-01-01T00:00:00.000Z", ()),
    ],
)
def test_times(text, spec, want, policies):
    t = parse(text, spec, 1709625600 * 10**9)  # 2024-03-05T08:00:00Z
    assert (format_rfc3339(t.ns), t.policies, t.error) == (want, policies, None)


@pytest.mark.parametrize(("text", "spec", "error"), [("", "auto", "empty"), ("19991231", "auto", "no_match"), ("2023-02-29 10:00:00", "rfc3339", "out_of_range"), ("Feb 29 01:02:03", "syslog", "out_of_range"), ("2300-01-01T00:00:00Z", "rfc3339", "out_of_range"), ("+5", "epoch", "no_match")])
def test_time_errors(text, spec, error):
    assert parse(text, spec, 1673308800 * 10**9).error == error


def test_offsets_and_native_epochs(spark):
    assert [parse_offset(x) for x in ("Z", "+05:30", "-0330", "19800", "+15:00", "x")] == [0, 19800, -12600, 19800, None, None]
    rows = ["1788516923", "1756980923.123", "1788516923123456", "1788516923123456789", "99999999", "x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(epoch_auto_ns(F.col("t"))).collect()]
    assert got == [parse(x, "auto", RECEIPT).ns for x in rows]


# -- strategies -------------------------------------------------------------------------


def test_kv():
    assert st.kv('a=1 b="x \\"y\\"" bare c= a=2 =z d="open') == [("a", "1"), ("b", 'x "y"'), ("c", ""), ("a", "2"), ("d", "open")]
    assert st.kv("a:1;b:'q;r'", ":", ";", "'\"") == [("a", "1"), ("b", "q;r")]
    with pytest.raises(st.Failed, match="no_pairs"):
        st.kv("nothing here")


def test_delimiter():
    assert st.delimiter("a,b,,d,", ",", ["x", "_", "y"]) == [("x", "a"), ("y", ""), ("column_4", "d"), ("column_5", "")]
    assert st.delimiter("a,b,c,d", ",", ["x"], "rest") == [("x", "a"), ("rest", "b,c,d")]
    assert st.delimiter('"a,b"junk,c', ",", ["x", "y"], quote='"') == [("x", "a,b"), ("y", "c")]


def test_structured():
    assert st.json_fields('{"b": [1, {"c": null, "d": "x"}], "a": 1e3, "t": true}') == [("a", "1e3"), ("b.0", "1"), ("b.1.d", "x"), ("t", "true")]
    for bad in ("[1]", "{", "nope"):
        with pytest.raises(st.Failed, match="invalid_json"):
            st.json_fields(bad)
    got = dict(st.cef("x CEF:0|V|P\\|Q|1|id|na|5|src=1.1.1.1 msg=a\\=b c\\nd dst=2"))
    assert (got["device_product"], got["src"], got["msg"], got["dst"]) == ("P|Q", "1.1.1.1", "a=b c\nd", "2")
    assert st.leef("LEEF:2.0|V|P|1|E|x5E|a=1^b=2")[-2:] == [("a", "1"), ("b", "2")]
    assert st.leef("LEEF:1.0|V|P|1|E|a=1\tb=2")[-2:] == [("a", "1"), ("b", "2")]
    with pytest.raises(st.Failed, match="invalid_leef"):
        st.leef("LEEF:2.0|V|P|1|E|zz|a=1")


def test_xml():
    text = "<e:Event><System><Id>4</Id><T S='now'/></System><D><Data Name='User'>a&amp;b</Data><Data Name='IP'>1</Data><p>x</p><p>y</p></D>"
    assert st.xml(text) == [("System.Id", "4"), ("System.T.S", "now"), ("D.User", "a&b"), ("D.IP", "1"), ("D.p", "x"), ("D.p2", "y")]
    with pytest.raises(st.Failed, match="invalid_xml"):
        st.xml("<a><b></c></a>")


def test_patterns():
    p = "{user:word} from {ip:ip}{? port {port:port}} {{x}} {_:rest}"
    assert st.pattern_of(st.tokens_of(p)) == p
    assert st.pattern("bob  from 10.0.0.1 port 22 {x} tail", [p]) == [("user", "bob"), ("ip", "10.0.0.1"), ("port", "22")]
    assert st.pattern("bob from ::1 {x} ", [p]) == [("user", "bob"), ("ip", "::1")]
    assert st.pattern("k=v", [], regexes=["(?P<key_1>k)=(?P<v>v)"]) == [("key_1", "k"), ("v", "v")]
    with pytest.raises(st.Failed, match="pattern_no_match"):
        st.pattern("x", [p])
    p = "{ts:timestamp} {host:word} {msg:rest}"
    assert st.pattern("Mar  1 06:07:08 CORE link up", [p]) == [("ts", "Mar  1 06:07:08"), ("host", "CORE"), ("msg", "link up")]
    for stamp in ("Mar  1 06:07:08 EST", "Fri Mar  1 06:07:08 2024", "2024-03-01T06:07:08.25+01:00", "2024/03/01 06:07:08 UTC", "[01/Mar/2024:06:07:08 -0500]", "1709283661"):
        assert st.pattern(f"{stamp} box up", [p])[:2] == [("ts", stamp), ("host", "box")]
    with pytest.raises(ValueError, match="nest"):
        st.tokens_of("{?a{?b}}")


def test_envelope():
    assert st.envelope("<191>Sep  4 10:15:24 h msg")[0][:3] == [("syslog_pri", "191"), ("syslog_facility", "23"), ("syslog_severity", "7")]
    assert st.envelope("<192>x") == ([], "<192>x")
    fields, body = st.envelope('<34>1 2026-09-04T10:15:23Z host app - ID7 [a@1 k="v\\"w" z="1"] hello')
    assert dict(fields)["k"] == 'v"w' and dict(fields)["syslog_app"] == "app" and body == "hello"
    fields, body = st.envelope("<34>1 2026-09-04T10:15:23Z host app 1 ID7 [broken hello")
    assert body == "[broken hello"


# -- framing and store --------------------------------------------------------------------


def brute_frame(text):
    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        if out and line[0] in " \t\r\n":
            out[-1] += line
        else:
            out.append(line)
    return out


def test_frames(spark):
    r = random.Random(1)
    texts = ["", "\n\n\n", "a\n b\n\nc\r\nd", *("".join(r.choice("ab \t\r\n\n") for _ in range(r.randint(0, 30))) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "source int, text string")
    got: dict[int, list[str]] = {}
    for row in framing.frame(df).orderBy("source", "pos").collect():
        got.setdefault(row.source, []).append(row.event)
    assert [got.get(i, []) for i in range(len(texts))] == [brute_frame(t) for t in texts]
    lines = [(i, n, x) for i, t in enumerate(texts) for n, x in enumerate(re.findall(r"[^\n]*\n|[^\n]+$", t))]
    same = {}
    for row in framing.frame_lines(spark.createDataFrame(lines, "source int, line_no int, line string")).orderBy("source", "pos").collect():
        same.setdefault(row.source, []).append(row.event)
    assert same == got
    for t in texts:
        events, rest = framing.split_complete(t, False)
        assert "".join(events) + rest == t and framing.split_complete(t, True)[0] == brute_frame(t)


def test_globs():
    assert framing.glob_match("*.log", "a/b/x.log") and not framing.glob_match("a/*.log", "a/b/x.log")
    assert framing.glob_match("a/**/x.?og", "a/b/c/x.log") and framing.glob_match("a/**/x.log", "a/x.log")


def test_store(spark):
    events = spark.createDataFrame([(i * 7 % 50, f"event {i}") for i in range(50)], "k int, text string").repartition(5)
    ids = store.dense_ids(events, ["k"]).select("raw_id", F.col("text").cast("binary").alias("bytes"), "k")
    assert sorted(r.raw_id for r in ids.collect()) == list(range(50)) and ids.where("raw_id <> k").count() == 0
    records = ids.withColumn("sha256", store.digest(F.col("bytes")))
    start = store.genesis("s")
    full = records.join(store.chain(records, start, 16).select("raw_id", "chain"), "raw_id").cache()
    assert store.verify(full, start).count() == 0
    spoiled = full.withColumn("bytes", F.when(F.col("raw_id") == 7, F.lit(b"x")).otherwise(F.col("bytes"))).withColumn("chain", F.when(F.col("raw_id") == 20, F.unhex(F.lit("00"))).otherwise(F.col("chain")))
    assert sorted(map(tuple, store.verify(spoiled, start).collect())) == [(7, "digest"), (20, "chain"), (21, "chain")]
    document = store.attest(full, 16)
    assert sorted(r.raw_id for r in document.collect()) == [0, 16, 32, 48, 49]
    assert store.verify_against(full, document).count() == 0
    assert [r.raw_id for r in store.verify_against(spoiled, store.attest(full, 10)).collect()] == [20]


# -- definitions and the whole plan ---------------------------------------------------------


def test_definitions(tmp_path):
    parsers, problems = definitions.load_parsers()
    assert not problems and [p.name for p in parsers][-1] == "json_events"
    (tmp_path / "a.toml").write_text('[parser]\nname = "a"\n[match]\ncontains = ["x"]\n[strategy]\nkind = "kv"\ndelimiter = ","\n')
    (tmp_path / "b.toml").write_text('[parser]\nname = "b"\n[match]\nregex = "x"\n[strategy]\nkind = "json"\n')
    (tmp_path / "c.toml").write_text("not toml")
    parsers, problems = definitions.load_parsers(tmp_path)
    assert [p.name for p in parsers] == ["b"] and len(problems) == 2 and problems[0].startswith("a.toml")
    for name in ("ocsf", "ecs"):
        mapping, problems = definitions.load_mapping(name)
        assert mapping and not problems


LINES = [
    '<164>Sep  4 10:15:24 edge-1 %ASA-4-106023: Deny tcp src outside:203.0.113.9/44321 dst inside:10.0.0.7/22 by access-group "in" [0x0]\n',
    '<189>date=2026-09-04 time=10:15:23 tz="+0530" devname="fw" srcip=10.0.0.1 dstip=10.0.0.2 dstport=0x50 action="weird" x=1 x=2 y=-\n',
    "<134>Sep  4 10:15:24 filterlog[12]: 5,,,100,em0,match,block,in,4,0x0,,64,1,0,DF,6,tcp,60,10.0.0.1,10.0.0.2,1234,80,0,S",
    '{"timestamp": "2026-09-04T10:15:23Z", "src_ip": "10.0.0.3", "user": "ann\xff"}',
    "no such format \xff",
    '{"a": 1} trailing',
]


def test_plan(spark):
    parsers, _ = definitions.load_parsers()
    mapping, _ = definitions.load_mapping()
    raw = spark.createDataFrame([(i, "s", RECEIPT, bytearray(x.encode("latin-1"))) for i, x in enumerate(LINES)], "raw_id long, source string, receipt_ns long, bytes binary").repartition(3)
    parsed = {r.raw_id: r for r in pipeline.parse_events(raw, parsers).collect()}
    assert [parsed[i].parser for i in range(6)] == ["asa", "kv_firewall", "filter_csv", "json_events", None, None]
    assert [parsed[i].sub_status for i in range(3)] == ["matched", "not_applicable", "matched"]
    assert parsed[0].time_policies == ["year_assumed", "tz_assumed"]
    events = pipeline.normalize_events(pipeline.parse_events(raw, parsers), mapping, parsers)
    got = {r.raw_id: r for r in events.collect()}
    assert (got[0].class_uid, got[0].src_ip, got[0].dst_port, got[0].device) == (4001, "203.0.113.9", 22, "edge-1")
    import json

    one = json.loads(got[1].normalized)
    assert one["action"] == "Other" and one["action_id"] == 99 and one["dst_endpoint"]["port"] == 80 and got[1].enum_miss == ["action"]
    assert one["unmapped"]["x"] == "1" and one["unmapped"]["x#2"] == "2" and one["unmapped"]["action"] == "weird" and "y" not in one["unmapped"]
    assert got[4].time_policies == ["receipt_fallback"] and got[4].time == RECEIPT // 10**6 and got[4].class_uid == 0 and got[4].utf8_lossy
    c = an.counters(events).first()
    assert (c.events, c.detected, c.no_parser, c.utf8_lossy) == (6, 4, 2, 1 + 1 * got[3].utf8_lossy)
    assert pipeline.parse_events(raw, parsers, only=["asa"]).count() == 1
    again = pipeline.normalize_events(pipeline.parse_events(raw, parsers), mapping, parsers)
    one_pass = pipeline.process_events(raw, parsers, mapping)
    assert sorted(map(tuple, one_pass.collect())) == sorted(map(tuple, again.collect()))
    assert an.replay_diff(events, again).where("change <> 'unchanged'").count() == 0
    posts = an.postings(events)
    assert {(r.kind, r.value) for r in an.related(posts, "src_ip", "10.0.0.1").collect()} >= {("dst_ip", "10.0.0.2"), ("dst_port", "80")}
    lines = [r.line for r in sinks.csv_lines(events).orderBy("raw_id").collect()]
    assert lines[0].count('""') > 2 and lines[4].startswith("4,")
    assert pipeline.provenance([("src_ip", "1"), ("action", "deny")], mapping) == [("action", 1, True, "Denied"), ("src_endpoint.ip", 0, False, "1")]


def test_as_int():
    assert [pipeline.as_int(x) for x in ("0x1F", "-5", "+7", " 5", "9223372036854775808", "a", "0x")] == [31, -5, 7, " 5", "9223372036854775808", "a", "0x"]


# -- analytics and streams --------------------------------------------------------------------


def test_drift(spark):
    rows = [("a", w, 512, m) for w, m in enumerate([0, 0, 0, 300, 300, 0, 0, 0, 0, 0])] + [("b", w, 512, 300) for w in range(5)] + [("c", w, 512, m) for w, m in enumerate([0, 0, 400])]
    df = spark.createDataFrame([(*r, True) for r in rows], "source string, window long, events long, misses long, full boolean")
    got = {r.source: (r.tripped, r.trips, r.baseline_events) for r in an.drift_states(df).collect()}
    assert got == {"a": (False, 1, 512), "b": (False, 0, 2560), "c": (True, 1, 1024)}


def test_routing_and_clearing(spark):
    """Failed lines go to inference only after the trip; a cleared source starts anew."""
    n = 512
    e = spark.range(6 * n).select(F.col("id").alias("raw_id"), F.lit("a").alias("source"), F.when((F.col("id") >= 2 * n) & (F.col("id") % 2 == 0), "no_pairs").when(F.col("id") == 5, "no_parser").otherwise("parsed").alias("parse_status"))
    states = lambda x: an.drift_states(an.drift_windows(x, F.col("source"), F.col("parse_status") != "parsed", "raw_id"))
    got = states(e).first()
    assert (got.tripped, got.since) == (True, 3 * n - 1)
    routed = sorted(r.raw_id for r in an.routed(e, states(e)).collect())
    assert routed == [5, *range(3 * n, 6 * n, 2)]
    cleared = spark.createDataFrame([("a", 10), ("a", 4 * n - 1)], "source string, raw_id long")
    assert an.since_clear(e, cleared).agg(F.min("raw_id")).first()[0] == 4 * n
    again = states(an.since_clear(e, cleared)).first()
    assert (again.tripped, again.since, again.baseline_events) == (False, None, 2 * n)
    assert an.since_clear(e, cleared.limit(0)).count() == 6 * n
    assert an.routed(e, states(e.limit(0))).count() == 1


def test_flags_and_dictionaries(spark):
    rows = [(1, "parsed", "matched", ["utc"], None, 3, 0, False), (2, "no_parser", "uncovered", ["receipt_fallback"], "bad_hour", 0, 2, True)]
    e = spark.createDataFrame(rows, "raw_id long, parse_status string, sub_status string, time_policies array<string>, time_error string, class_uid long, unmapped_fields int, utf8_lossy boolean")
    got = [tuple(r)[1:] for r in an.trust_flags(e).orderBy("raw_id").collect()]
    assert got == [(False, False, False, False, False, False, False, 0, False), (True, False, True, False, True, True, True, 2, True)]
    left, right = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1, "x")], "id int, v string")
    assert [r.v for r in an.look_up(left, right, "k", "id").collect()] == ["x"]
    assert sorted(str(r.v) for r in an.look_up(left, right, "k", "id", required=False).collect()) == ["None", "None", "x"]
    p = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", None), ("t", "b")], "source string, parser string")
    assert {(r.parser, r.events) for r in an.parser_hits(p).collect()} == {("a", 2), ("b", 1)}
    assert {tuple(r) for r in an.source_parsers(p).collect()} == {("s", "a", 2), ("t", "b", 1)}


def test_pages(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(30)], "time long, raw_id long")
    page, cursor = [], None
    while True:
        rows = an.keyset_page(df, ["time", "raw_id"], 7, cursor).collect()
        page += [r.raw_id for r in rows]
        if len(rows) < 7:
            break
        cursor = tuple(rows[-1])
    assert page == list(range(29, -1, -1))


def test_syslog_frames():
    assert syslog.tcp_frames(b"5 hello3 abc2 x") == ([b"hello", b"abc"], b"2 x")
    assert syslog.tcp_frames(b"one\n two\nthree\n") == ([b"one\n two\n"], b"three\n")
    assert syslog.tcp_frames(b"12 short", eof=True) == ([b"12 short"], b"")
    assert syslog.udp_event(b"x", "10.0.0.1") == ("udp/10.0.0.1", b"x")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(b"one\n two\nthree\xff\n")
    seen = []
    q = syslog.serve(syslog.tail_folder(spark, str(tmp_path / "in")), lambda df: df, lambda df, i: seen.extend(df.orderBy("pos").collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert [bytes(r.bytes) for r in seen] == [b"one\n two\n", b"three\xff\n"]


def test_inference(spark):
    lines = [f"user bob{i} logged in from 10.0.0.{i} port {1000 + i}" for i in range(20)] + [f"disk sda{i} usage {i}.5 percent full now" for i in range(9)] + ["odd one out", ""]
    found, reasons = infer.infer_lines(lines)
    assert len(found) == 2 and sum(v for _, _, v in found) == 29 and reasons["empty"] == 1 and reasons["below_support"] == 1
    assert "{from:ipv4}" in found[0][0] or "{from:ipv4}" in found[1][0]
    assert infer.fingerprint(["a"]) != infer.fingerprint(["b"]) and infer.slug("x/My App-1.log") == "my_app_1"
    assert "+b" in infer.changes("a", "b")
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "source string, raw_id long, line string")
    rows = infer.infer_templates(df).collect()
    assert len(rows) == 2 and definitions.parser_of(__import__("tomllib").loads(rows[0].definition)).name == "s"


def test_inference_reads_all_members_and_whole_lines():
    import random

    late = [f"job {'x' if i < 100 else 'y'} took {i} ms" for i in range(120)]
    found, _ = infer.infer_lines(late)
    assert [(n, v) for _, n, v in found] == [(120, 120)]
    same = "a " * 80
    assert infer.similarity(("z " + same + "b " * 80).split(), ("c " * 90 + same).split()) == 160 / 331
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        pairs = infer.lcs(a, b)
        assert infer.lcs_length(a, b) == len(pairs) and all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


def test_engine(spark, tmp_path):
    import shutil

    from logloom.engine import Engine

    logs, parsers = tmp_path / "logs", tmp_path / "parsers"
    logs.mkdir()
    shutil.copytree(definitions.HERE / "parsers", parsers)
    (logs / "a.log").write_bytes("".join(x if x.endswith("\n") else x + "\n" for x in LINES).encode("latin-1"))
    (logs / "b.log").write_text("".join(f"login of user{i} took {i} ms\n" for i in range(8)))
    (logs / "README").write_text("not a log")
    e = Engine(spark, str(tmp_path / "state"), str(parsers))
    assert e.ingest(str(logs), receipt_ns=RECEIPT) == 14
    assert e.verify().count() == 0 and e.attest().count() == 2
    assert e.metrics().first().events == 14 and e.tail(limit=3).count() == 3
    assert [r.value for r in e.entities("src_ip", "203.").collect()] == ["203.0.113.9"]
    page = e.pivot("src_ip", "10.0.0.1")
    assert page["events"].count() == 2 and page["header"].first().events == 2
    t = e.traceback(0)
    assert t["fields"][0][0] == "syslog_pri" and t["line"] and len(t["sha256"]) == 64
    assert e.infer() == 1
    r = e.review()
    assert r.pending().count() == 1 and r.diff("b.log")
    r.approve("b.log")
    assert r.pending().count() == 0 and e.reload() == []
    v = e.replay()
    assert {x.change for x in e.diff_page(1, v).collect()} == {"changed"} and e.diff_page(1, v).count() == 8
    assert e.export(0, 5, ["DENY"]).count() >= 1 and e.drift_alerts().count() == 0
    # events that come after a replay are seen, and an ingest that broke off behind its first table is completed
    more = tmp_path / "more"
    more.mkdir()
    (more / "c.log").write_text("late line\n")
    assert e.ingest(str(more), receipt_ns=RECEIPT) == 1 and e.metrics().first().events == 15
    e.raw().where("raw_id = 0").withColumn("raw_id", F.lit(15).cast("long")).write.mode("append").parquet(f"{e.root}/raw")
    assert e.ingest(str(more), receipt_ns=RECEIPT) == 1
    assert e.metrics().first().events == 17 and e.records().count() == 17 and e.verify().count() == 0


def test_drift_machine():
    from logloom.streaming.stateful import judge

    s, trips = (0, 0, False, 0), 0
    for m in [0, 0, 0, 300, 300, 0, 0, 0, 0, 0]:
        s, t = judge(s, 512, m)
        trips += t
    assert (s, trips) == ((512, 0, False, 0), 1)
