"""The reference workload's operators on the driver's tables, each with DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship
from ..functions import strategies
from ..functions.timestamps import epoch_auto_ns
from ..operators import analytics as an
from ..operators import framing, store
from ..operators.infer import infer_templates
from .definitions import Mapping, Step, ascii_lower, detect, load_mapping, load_parsers, parser_of
from .pipeline import _arrow, _columns, choose, class_of, normalize_event, process_events, run_subs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


# -- framing and store ---------------------------------------------------------------

_ISLANDS = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS m FROM documents),
b AS (SELECT doc_id, n, CASE WHEN n < m THEN line || chr(10) ELSE line END AS line FROM l),
s AS (SELECT *, sum(CASE WHEN n = 1 OR NOT regexp_matches(line, '^[ \t\r\n]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM b WHERE line <> ''),
e AS (SELECT doc_id, island, string_agg(line, '' ORDER BY n) AS event FROM s GROUP BY ALL)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.frame(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(_ISLANDS + "SELECT doc_id, (island - 1)::INTEGER AS pos, event FROM e")
def frame_lines(spark, sf_dir):
    return _events(spark, sf_dir)


@query(_ISLANDS + "SELECT doc_id, count(*) AS events, sum(strlen(event))::BIGINT AS bytes FROM e GROUP BY doc_id")
def frame_summary(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("events"), F.sum(F.octet_length("event")).cast("long").alias("bytes"))


@query("SELECT doc_id, sha256(text) AS digest, strlen(text)::BIGINT AS bytes FROM documents")
def event_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(store.digest(F.col("text").cast("binary")))).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS raw_id FROM events")
def dense_ids(spark, sf_dir):
    return store.dense_ids(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "raw_id")


@query("""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id, sha256(text) AS h FROM documents),
c(n, doc_id, link) AS (
  SELECT 0::BIGINT, (-1)::BIGINT, sha256('logloom chain genesis' || 'store') UNION ALL
  SELECT d.n, d.doc_id, sha256(unhex(c.link) || unhex(d.h)) FROM c JOIN d ON d.n = c.n + 1)
SELECT doc_id AS raw_id, link FROM c WHERE n > 0
""")
def chain_links(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("raw_id"), store.digest(F.col("text").cast("binary")).alias("sha256"))
    return store.chain(docs, store.genesis("store")).select("raw_id", F.lower(F.hex("chain")).alias("link"))


@query("SELECT doc_id AS raw_id, 'digest' AS fault FROM documents WHERE doc_id % 97 = 5")
def chain_verify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("raw_id"), F.col("text").cast("binary").alias("bytes"))
    docs = docs.withColumn("sha256", store.digest(F.col("bytes")))
    links = store.chain(docs, store.genesis("store")).select("raw_id", "chain")
    bad = F.when(F.col("raw_id") % 97 == 5, F.concat("bytes", F.lit(b"!"))).otherwise(F.col("bytes"))
    return store.verify(docs.join(links, "raw_id").withColumn("bytes", bad), store.genesis("store"))


@query("SELECT event_id AS raw_id, user_id FROM events WHERE event_id % 4096 = 0 OR event_id = (SELECT max(event_id) FROM events)")
def attest_checkpoints(spark, sf_dir):
    return store.attest(table(spark, sf_dir, "events").select(F.col("event_id").alias("raw_id"), "user_id"))


@query("SELECT source, sum(strlen(text))::BIGINT AS bytes_stored, count(*) AS events FROM documents GROUP BY source")
def resume_offsets(spark, sf_dir):
    return store.resume_offsets(table(spark, sf_dir, "documents"), "text").withColumn("bytes_stored", F.col("bytes_stored").cast("long"))


def _each(df: DataFrame, ddl: str, make: Callable[[dict], Iterable[tuple]]) -> DataFrame:
    """The rows that ``make`` gives for each row, in Arrow batches."""
    ship(df.sparkSession)
    names = [x.split(" ")[0] for x in ddl.split(", ")]

    def run(batches):
        for batch in batches:
            yield _columns([dict(zip(names, r, strict=True)) for row in batch.to_pylist() for r in make(row)], _arrow(ddl))

    return df.mapInArrow(run, ddl)


def _mapping(**parts) -> Mapping:
    """A mapping of the given parts, the others empty."""
    return Mapping(**{"name": "query", "version": "", "entities": {}, "absent": set(), "fields": {}, "ints": set(), "enums": [], "classes": [], "default_class": {}, **parts})


def _normal(fields: list[tuple[str, str]], m: Mapping) -> dict:
    """The schema object of an event with these fields."""
    row = {"raw_id": 0, "source": "", "receipt_ns": 0, "parser": "query", "parse_status": "parsed", "sub_status": "not_applicable", "epoch_ns": 0, "time_policies": [], "time_text": None, "time_error": None}
    return json.loads(normalize_event({**row, "fields": fields}, m, {})["normalized"])


# -- detection and strategies ----------------------------------------------------------


@query(r"""
SELECT doc_id, CASE WHEN contains(text, 'Licensed') THEN 'license' WHEN regexp_matches(text, '[0-9]{1,3}(\.[0-9]{1,3}){3}') THEN 'address'
  WHEN contains(text, ' | ') THEN 'table' WHEN starts_with(text, 'The') THEN 'the' END AS parser FROM documents
""")
def detect_dispatch(spark, sf_dir):
    tests = {"license": {"contains": "Licensed"}, "address": {"regex": r"[0-9]{1,3}(\.[0-9]{1,3}){3}"}, "table": {"contains": " | "}, "the": {"starts_with": "The"}}
    parsers = [parser_of({"parser": {"name": n}, "match": m, "strategy": {"kind": "kv"}}) for n, m in tests.items()]
    return table(spark, sf_dir, "documents").select("doc_id", detect(F.col("text"), parsers).alias("parser"))


def _fields(df: DataFrame, key: str, text: str, read: Callable[[str], strategies.Pairs], names: tuple[str, str]) -> DataFrame:
    """One row for each field that a strategy reads of a column's texts; a text that it refuses gives none."""
    ship(df.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf[key], pdf[text], strict=True):
                try:
                    pairs = read(t.encode().decode("latin-1")) if t is not None else []
                except strategies.Failed:
                    continue
                rows += [(i, *(x.encode("latin-1").decode() for x in pair)) for pair in pairs]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, text).mapInPandas(run, f"{key} long, {names[0]} string, {names[1]} string")


@query(r"""
SELECT page_id, regexp_extract(p, '^([^=]+)=', 1) AS k, regexp_extract(p, '=(.*)$', 1) AS v
FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS p FROM pages) WHERE regexp_matches(p, '^[^=]+=')
""")
def kv_pairs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"\?([^#]*)", 1).alias("q"))
    return _fields(pages, "page_id", "q", lambda t: strategies.kv(t, "=", "&"), ("k", "v"))


@query(r"""
SELECT page_id, n::INTEGER AS pos, v FROM (SELECT page_id, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS n
FROM (SELECT page_id, string_split(url, '/') AS s FROM pages))
""")
def delimiter_columns(spark, sf_dir):
    columns = _fields(table(spark, sf_dir, "pages"), "page_id", "url", lambda t: strategies.delimiter(t, "/", []), ("column", "v"))
    return columns.select("page_id", (F.regexp_extract("column", "column_([0-9]+)", 1).cast("int") - 1).alias("pos"), "v")


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS v FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_flatten(spark, sf_dir):
    return _fields(table(spark, sf_dir, "events"), "event_id", "props", strategies.json_fields, ("path", "v"))


@query(r"SELECT p_partkey, regexp_extract(p_name, '^(\S+) (.+)$', 1) AS first_word, regexp_extract(p_name, '^(\S+) (.+)$', 2) AS rest, regexp_extract(p_brand, '^Brand#([0-9]+)', 1)::INTEGER AS brand FROM part")
def pattern_extract(spark, sf_dir):
    def read(row):
        name, brand = slots(row["p_name"], "{first:word} {more:text}"), slots(row["p_brand"], "Brand#{n:int}")
        yield row["p_partkey"], name.get("first", ""), name.get("more", ""), int(brand["n"]) if brand else None

    def slots(text, pattern):
        try:
            return dict(strategies.pattern(text or "", [pattern]))
        except strategies.Failed:
            return {}

    return _each(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey long, first_word string, rest string, brand int", read)


@query("""
SELECT event_id, CASE WHEN event_type NOT IN ('purchase', 'click') THEN 'not_applicable' WHEN json_extract_string(props, '$.k') IS NULL THEN 'no_match'
  WHEN json_extract_string(props, '$.k')::INTEGER >= 50 THEN 'matched' ELSE 'uncovered' END AS sub_status FROM events
""")
def sub_gate(spark, sf_dir):
    sub = Step("pattern", {"regexes": ['"k": *(?P<k>[0-9]+)'], "anchor": "none"}, "props", {"grade": ["high"]})

    def gate(row):
        fields = [("grade", row["grade"])] + ([("props", row["props"])] if row["event_type"] in ("purchase", "click") else [])
        yield row["event_id"], run_subs((sub,), fields)

    low = F.get_json_object("props", "$.k").cast("int") < 50
    return _each(table(spark, sf_dir, "events").select("event_id", "event_type", "props", F.when(low, "low").otherwise("high").alias("grade")), "event_id long, sub_status string", gate)


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000000 WHEN 1 THEN epoch_us(ts) // 1000 * 1000000 ELSE epoch_us(ts) * 1000 END AS ns FROM events
""")
def time_epoch_auto(spark, sf_dir):
    us = micros("ts")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.floor(us / 1000000).cast("string")).when(F.col("event_id") % 4 == 1, F.floor(us / 1000).cast("string"))
        .when(F.col("event_id") % 4 == 2, us.cast("string")).otherwise((us * 1000).cast("string"))
    )
    return table(spark, sf_dir, "events").select("event_id", epoch_auto_ns(text).alias("ns"))


# -- normalising ---------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN event_type IN ('signup') THEN 3002 WHEN event_type IN ('view', 'click') THEN 4002 WHEN event_type = 'purchase' AND value > 0 THEN 6003 ELSE 0 END::BIGINT AS class_uid FROM events
""")
def class_rules(spark, sf_dir):
    m = _mapping(classes=[{"uid": 3002, "when": [{"type": "signup"}]}, {"uid": 4002, "when": [{"type": ["view", "click"]}]}, {"uid": 6003, "when": [{"type": "purchase", "sign": "plus"}]}])

    def rule(row):
        fields = [("type", row["event_type"]), ("sign", row["sign"])]
        yield row["event_id"], class_of(fields, m, [ascii_lower(v) for _, v in fields]).get("uid", 0)

    sign = F.when(F.col("value") > 0, "plus").otherwise("other")
    return _each(table(spark, sf_dir, "events").select("event_id", "event_type", sign.alias("sign")), "event_id long, class_uid long", rule)


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Open' ELSE 'Other' END AS status, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 99 END::INTEGER AS status_id,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE o_orderstatus END AS unmapped FROM orders
""")
def enum_map(spark, sf_dir):
    other = {"value": "Other", "id": 99}
    values = [{"value": "Closed", "id": 2, "raw": ["F"]}, {"value": "Open", "id": 1, "raw": ["O"]}]
    m = _mapping(fields={"status": ["s"]}, enums=[{"field": "status", "id_field": "status_id", "values": values, "other": other, "unknown": other}])

    def enum(row):
        out = _normal([("s", row["s"])] if row["s"] is not None else [], m)
        yield row["o_orderkey"], out["status"], out["status_id"], out.get("unmapped", {}).get("s")

    return _each(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s")), "o_orderkey long, status string, status_id int, unmapped string", enum)


@query("""
SELECT doc_id, CASE WHEN lang <> 'en' THEN 'lang' WHEN source IS NOT NULL THEN 'source' END AS fed_by, CASE WHEN lang <> 'en' THEN lang ELSE source END AS value FROM documents
""")
def alias_choose(spark, sf_dir):
    m = _mapping(absent={"en"}, fields={"tag": ["lang", "source"]})

    def tag(row):
        fields = [(k, row[k]) for k in ("source", "lang") if row[k] is not None]
        i = choose(fields, m).get("tag")
        yield (row["doc_id"], *(fields[i] if i is not None else (None, None)))

    return _each(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id long, fed_by string, value string", tag)


@query(r"""
WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w, generate_subscripts(string_split_regex(lower(text), '[^a-z]+'), 1) AS p FROM conversations),
n AS (SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY p) AS n FROM w WHERE w IN ('the', 'de', 'der'))
SELECT conv_id, turn, CASE WHEN n = 1 THEN w ELSE w || '#' || n END AS key FROM n
""")
def unmapped_keys(spark, sf_dir):
    m = _mapping()

    def keys(row):
        for key in _normal([(w, "x") for w in row["words"] or ()], m).get("unmapped", {}):
            yield row["conv_id"], row["turn"], key

    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w.isin("the", "de", "der"))
    return _each(table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words")), "conv_id long, turn long, key string", keys)


# -- counters ------------------------------------------------------------------------------


@query("""
SELECT count(*) AS events, count(*) FILTER (event_type <> 'error') AS detected, count(*) FILTER (event_type = 'error') AS no_parser, count(*) FILTER (event_type = 'view') AS parse_failed,
  count(*) FILTER (event_id % 5 = 0) AS sub_uncovered, count(*) FILTER (event_id % 5 = 1) AS sub_no_match, count(*) FILTER (event_id % 7 = 0) AS time_from_receipt, count(*) FILTER (user_id % 3 = 0) AS class_unknown,
  sum(strlen(props))::BIGINT AS unmapped_fields, sum(event_id % 2)::BIGINT AS enum_unmapped, count(*) FILTER (value > 10) AS utf8_lossy FROM events
""")
def counter_block(spark, sf_dir):
    kind, n = F.col("event_type"), F.col("event_id")
    outcomes = table(spark, sf_dir, "events").select(
        F.when(kind != "error", kind).alias("parser"), F.when(kind == "error", "no_parser").when(kind == "view", "failed").otherwise("parsed").alias("parse_status"),
        F.when(n % 5 == 0, "uncovered").when(n % 5 == 1, "no_match").otherwise("matched").alias("sub_status"), F.when(n % 7 == 0, F.array(F.lit("receipt_fallback"))).otherwise(F.array(F.lit("utc"))).alias("time_policies"),
        (F.col("user_id") % 3).alias("class_uid"), F.octet_length("props").alias("unmapped_fields"), (n % 2).alias("enum_unmapped"), (F.col("value") > 10).alias("utf8_lossy"),
    )
    return an.counters(outcomes)


@query("""
WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL),
e AS (SELECT source, arg_max(lang, (n, lang)) AS established FROM n GROUP BY source),
s AS (SELECT source, count(*) AS events, count(*) FILTER (doc_id % 10 = 3) AS no_parser, count(*) FILTER (doc_id % 10 = 4) AS parse_failed, max(doc_id) AS last_seen FROM documents GROUP BY source)
SELECT s.source, s.events, s.no_parser, s.parse_failed, s.last_seen, e.established FROM s LEFT JOIN e ON s.source IS NOT DISTINCT FROM e.source
""")
def source_stats(spark, sf_dir):
    status = F.when(F.col("doc_id") % 10 == 3, "no_parser").when(F.col("doc_id") % 10 == 4, "failed").otherwise("parsed")
    return an.source_stats(table(spark, sf_dir, "documents").select("source", F.col("lang").alias("parser"), status.alias("parse_status"), F.col("doc_id").alias("time")))


@query("SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def reason_counts(spark, sf_dir):
    return an.by_reason(table(spark, sf_dir, "events"), "event_type")


@query("SELECT lang AS parser, count(*) AS events FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def parser_hits(spark, sf_dir):
    return an.parser_hits(table(spark, sf_dir, "documents").select(F.col("lang").alias("parser")))


@query("SELECT source, lang AS parser, count(*) AS events FROM documents WHERE lang IS NOT NULL GROUP BY source, lang")
def source_parsers(spark, sf_dir):
    return an.source_parsers(table(spark, sf_dir, "documents").select("source", F.col("lang").alias("parser")))


@query("""
SELECT event_id AS raw_id, event_type = 'error' AS no_parser, event_type = 'view' AS parse_failed, event_id % 5 = 0 AS sub_uncovered, event_id % 5 = 1 AS sub_no_match, event_id % 7 = 0 AS time_from_receipt,
  event_id % 9 = 0 AS time_error, user_id % 3 = 0 AS class_unknown, strlen(props)::INTEGER AS unmapped, value > 10 AS utf8_lossy FROM events
""")
def trust_flags(spark, sf_dir):
    kind, n = F.col("event_type"), F.col("event_id")
    return an.trust_flags(table(spark, sf_dir, "events").select(
        n.alias("raw_id"), F.when(kind == "error", "no_parser").when(kind == "view", "invalid_json").otherwise("parsed").alias("parse_status"), F.when(n % 5 == 0, "uncovered").when(n % 5 == 1, "no_match").otherwise("matched").alias("sub_status"),
        F.when(n % 7 == 0, F.array(F.lit("receipt_fallback"))).otherwise(F.array()).alias("time_policies"), F.when(n % 9 == 0, "bad_hour").alias("time_error"), (F.col("user_id") % 3).alias("class_uid"),
        F.octet_length("props").alias("unmapped_fields"), (F.col("value") > 10).alias("utf8_lossy"),
    ))


# -- entities ------------------------------------------------------------------------------

_POSTS = """
WITH p AS (
  SELECT 'user' AS kind, user_id::VARCHAR AS value, event_id AS raw_id, epoch_us(ts) AS time, event_type AS device FROM events UNION ALL
  SELECT 'device', event_type, event_id, epoch_us(ts), event_type FROM events)
"""


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.struct(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("value")), F.struct(F.lit("device").alias("kind"), F.col("event_type").alias("value")))
    out = table(spark, sf_dir, "events").select(F.explode(kinds).alias("e"), F.col("event_id").alias("raw_id"), micros("ts").alias("time"), F.col("event_type").alias("device"))
    return out.select("e.kind", "e.value", "raw_id", "time", "device")


@query(_POSTS + "SELECT kind, value, count(*) AS events, min(time) AS first_seen, max(time) AS last_seen, count(DISTINCT device) AS devices FROM p GROUP BY ALL")
def entity_summary(spark, sf_dir):
    return an.entity_summary(_posts(spark, sf_dir))


@query(_POSTS + "SELECT value, count(*) AS events FROM p WHERE kind = 'user' AND starts_with(value, '1') GROUP BY value ORDER BY events DESC, value LIMIT 20")
def entity_prefix_topk(spark, sf_dir):
    return an.top_entities(_posts(spark, sf_dir), "user", "1", 20)


@query(_POSTS + "SELECT raw_id, time, device FROM p WHERE kind = 'user' AND value = '7' AND (time, raw_id) < (1704800000000000, 5000) ORDER BY time DESC, raw_id DESC LIMIT 50")
def pivot_page(spark, sf_dir):
    return an.timeline(_posts(spark, sf_dir), "user", "7", 50, (1704800000000000, 5000)).select("raw_id", "time", "device")


@query(_POSTS + """, w AS (SELECT raw_id FROM p WHERE kind = 'device' AND value = 'error' ORDER BY time DESC, raw_id DESC LIMIT 10000),
n AS (SELECT kind, value, count(*) AS events FROM p WHERE kind <> 'device' AND raw_id IN (SELECT raw_id FROM w) GROUP BY ALL)
SELECT kind, value, events, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY events DESC, value) AS r FROM n) WHERE r <= 10
""")
def related_values(spark, sf_dir):
    return an.related(_posts(spark, sf_dir), "device", "error")


@query("SELECT n_name, c_mktsegment, count(*) AS orders, count(s_suppkey) AS suppliers FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = o_custkey GROUP BY ALL")
def dictionary_join(spark, sf_dir):
    o, c, n, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "supplier"))
    both = an.look_up(an.look_up(o, c, "o_custkey", "c_custkey"), n, "c_nationkey", "n_nationkey")
    both = an.look_up(both, s, "o_custkey", "s_suppkey", required=False)
    return both.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.count("s_suppkey").alias("suppliers"))


# -- replay ---------------------------------------------------------------------------------

_NEW = """
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0)
"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    new = old.where(k % 13 != 0).withColumn("o_orderstatus", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(k % 11 != 0, F.col("o_orderpriority")))
    return old, new


@query(_NEW + """
SELECT o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'only_in_old' WHEN o.o_orderkey IS NULL THEN 'only_in_new' WHEN o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus THEN 'unchanged' ELSE 'changed' END AS change
FROM orders o FULL JOIN n USING (o_orderkey)
""")
def replay_diff(spark, sf_dir):
    return an.replay_diff(*_versions(spark, sf_dir), key="o_orderkey", line="o_orderstatus").select("o_orderkey", "change")


_PATHS = """, a AS (SELECT o_orderkey, 'o_orderstatus' AS path, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders),
b AS (SELECT o_orderkey, 'o_orderstatus' AS path, o_orderstatus AS v FROM n UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM n),
d AS (SELECT o_orderkey, path, a.v AS old, b.v AS new, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'lost' ELSE 'changed' END AS change
  FROM (SELECT * FROM a WHERE v IS NOT NULL) a FULL JOIN (SELECT * FROM b WHERE v IS NOT NULL) b USING (o_orderkey, path) WHERE a.v IS DISTINCT FROM b.v)
"""


@query(_NEW + _PATHS + "SELECT o_orderkey, path, change, old, new FROM d")
def diff_by_field(spark, sf_dir):
    return an.field_diff(*_versions(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query(_NEW + _PATHS + "SELECT path, change, count(*) AS events FROM d GROUP BY ALL")
def diff_summary(spark, sf_dir):
    return an.diff_summary(an.field_diff(*_versions(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_orderpriority"]))


# -- export, tail, drift ----------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'licensed')")
def export_filter(spark, sf_dir):
    return an.export(table(spark, sf_dir, "documents"), -(2**63), 2**63 - 1, ["The", "LICENSED"], "text", "doc_id").select("doc_id", "source")


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 100")
def tail_newest(spark, sf_dir):
    return an.tail(table(spark, sf_dir, "events"), -1, 100, key="event_id").select("event_id", "user_id")


@query("""
WITH n AS (SELECT event_type AS source, value > 20 AS missed, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 512 AS w FROM events)
SELECT source, w::BIGINT AS "window", count(*) AS events, count(*) FILTER (missed) AS misses, count(*) = 512 AS "full" FROM n GROUP BY ALL
""")
def drift_windows(spark, sf_dir):
    return an.drift_windows(table(spark, sf_dir, "events"), F.col("event_type"), F.col("value") > 20, "event_id").drop("last")


@query()
def drift_states(spark, sf_dir):
    return an.drift_states(an.drift_windows(table(spark, sf_dir, "events"), F.col("event_type"), F.col("value") > 20, "event_id"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("raw_id"), F.col("event_type").alias("source"), F.when(n == 0, "no_parser").when(n == 1, "no_pairs").otherwise("parsed").alias("parse_status"))


@query("""
SELECT event_id AS raw_id, event_type AS source FROM events
WHERE event_id % 4 = 0 OR event_id % 4 = 1 AND (event_type = 'view' AND event_id > 500 OR event_type = 'click' AND event_id > 100)
""")
def drift_routing(spark, sf_dir):
    states = spark.createDataFrame([("view", True, 500), ("click", True, 100), ("purchase", False, None)], "source string, tripped boolean, since long")
    return an.routed(_outcomes(spark, sf_dir), states).select("raw_id", "source")


@query("SELECT event_id AS raw_id, event_type AS source FROM events WHERE NOT (event_type = 'view' AND event_id <= 300 OR event_type = 'click' AND event_id <= 50)")
def drift_cleared(spark, sf_dir):
    cleared = spark.createDataFrame([("view", 200), ("view", 300), ("click", 50)], "source string, raw_id long")
    return an.since_clear(_outcomes(spark, sf_dir), cleared).select("raw_id", "source")


# -- whole plans ------------------------------------------------------------------------------


def device_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device lines written from the events table: every shipped parser has some."""
    e = table(spark, sf_dir, "events")
    day, ip = F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("10.0."), (F.col("user_id") % 250).cast("string"), F.lit("."), (F.col("event_id") % 250).cast("string"))
    port = (F.col("event_id") % 1000).cast("string")
    lines = [
        F.concat(F.lit("<189>date="), day, F.lit(" time="), F.date_format("ts", "HH:mm:ss"), F.lit(' devname="fw'), (F.col("event_id") % 3).cast("string"), F.lit('" srcip='), ip, F.lit(" dstip=192.0.2.7 dstport="), port, F.lit(" action="), F.when(F.col("value") > 20, "deny").otherwise("accept"), F.lit(" k="), F.col("event_type"), F.lit("\n")),
        F.concat(F.lit("<134>"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host1 CEF:0|Vendor|Box|1|"), port, F.lit("|flow|5|src="), ip, F.lit(" dst=192.0.2.8 dpt="), port, F.lit(" act=block rt="), F.floor(micros("ts") / 1000).cast("string")),
        F.concat(F.lit('{"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","src_ip":"'), ip, F.lit('","dest_ip":"192.0.2.9","user":"u'), F.col("user_id").cast("string"), F.lit('"}')),
        F.concat(F.lit("free text "), F.col("event_type")),
    ]
    which = F.element_at(F.array(*lines), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("raw_id"), F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("source"), (micros("ts") * 1000).alias("receipt_ns"), which.cast("binary").alias("bytes"))


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsers, _ = load_parsers()
    mapping, _ = load_mapping("ocsf")
    return process_events(device_logs(spark, sf_dir), parsers, mapping)


@query("""
SELECT event_id AS raw_id, CASE event_id % 4 WHEN 0 THEN 'kv_firewall' WHEN 1 THEN 'cef' WHEN 2 THEN 'json_events' END AS parser,
  CASE event_id % 4 WHEN 3 THEN 'no_parser' ELSE 'parsed' END AS parse_status, CASE event_id % 4 WHEN 3 THEN 0 WHEN 2 THEN 0 ELSE 4001 END::BIGINT AS class_uid,
  CASE event_id % 4 WHEN 3 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 * 1000 END AS time,
  CASE WHEN event_id % 4 < 3 THEN '10.0.' || (user_id % 250) || '.' || (event_id % 250) END AS src_ip,
  CASE WHEN event_id % 4 < 2 THEN event_id % 1000 END::INTEGER AS dst_port,
  CASE event_id % 4 WHEN 2 THEN 'u' || user_id END AS "user"
FROM events
""")
def ingest_normalized(spark, sf_dir):
    return _normalized(spark, sf_dir).select("raw_id", "parser", "parse_status", "class_uid", "time", "src_ip", "dst_port", "user")


@query()
def ingest_counters(spark, sf_dir):
    return an.counters(_normalized(spark, sf_dir))


@query()
def ingest_entities(spark, sf_dir):
    return an.entity_summary(an.postings(_normalized(spark, sf_dir)))


@query()
def infer_sources(spark, sf_dir):
    lines = device_logs(spark, sf_dir).select("source", F.col("raw_id"), F.col("bytes").cast("string").alias("line"))
    return infer_templates(lines)
