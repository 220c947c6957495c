"""Raw events to parsed and normalised ones: one narrow plan without a shuffle.

Detection is a native CASE over Latin-1 text.  Parsing and normalising need
ordered multimaps and scanners, so they run in Arrow batches; definitions are
plain data that travels with the function once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from ..functions import strategies as st
from ..functions.timestamps import Time, format_rfc3339, parse
from .definitions import ENTITY_KINDS, Mapping, Parser, Step, ascii_lower, detect

FIELDS = "fields array<struct<k:string,v:string>>"
PARSED = f"raw_id long, source string, receipt_ns long, parser string, parse_status string, sub_status string, {FIELDS}, epoch_ns long, time_policies array<string>, time_text string, time_error string"
NORMALIZED = "raw_id long, time long, class_uid long, parser string, source string, parse_status string, sub_status string, time_policies array<string>, time_error string, normalized string, src_ip string, dst_ip string, user string, dst_port int, device string, unmapped_fields int, enum_unmapped int, utf8_lossy boolean, enum_miss array<string>"


_ENCODE = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def latin1(content):
    """Bytes as text, one character a byte."""
    return F.decode(content, "ISO-8859-1")


def run_step(step: Step, text: str) -> st.Pairs:
    o = step.options
    if step.kind == "kv":
        return st.kv(text, o.get("key_value_separator", "="), o.get("pair_separator", " "), o.get("quote", '"'))
    if step.kind == "delimiter":
        return st.delimiter(text, o["delimiter"], o.get("fields", []), o.get("rest"), o.get("quote", '"'))
    if step.kind == "pattern":
        return st.pattern(text, o.get("patterns", []), o.get("anchor", "start"), o.get("regexes", ()))
    return {"json": st.json_fields, "cef": st.cef, "leef": st.leef, "xml": st.xml}[step.kind](text)


def first(fields: st.Pairs, key: str) -> str | None:
    return next((v for k, v in fields if k == key), None)


def run_subs(subs: tuple[Step, ...], fields: st.Pairs) -> str:
    """Re-parses fields in file order; of those on one field the first that matches wins.

    The worst outcome of any field is the event's: no_match, uncovered, matched, not_applicable.
    """
    states: dict[str, str] = {}
    for s in subs:
        text = first(fields, s.source)
        if text is None or states.get(s.source) == "matched":
            continue
        if any(first(fields, k) not in allowed for k, allowed in s.when.items()):
            states.setdefault(s.source, "uncovered")
            continue
        try:
            got = run_step(s, text)
        except st.Failed:
            states[s.source] = "no_match"
            continue
        fields += got
        fields += list(s.constants.items())
        states[s.source] = "matched"
    for state in ("no_match", "uncovered", "matched"):
        if state in states.values():
            return state
    return "not_applicable"


def resolve_time(p: Parser | None, fields: st.Pairs, receipt_ns: int, offset: int) -> tuple[Time, str | None]:
    """The first candidate that resolves, then the syslog stamp; an error only if none does."""
    error = None
    candidates = [*(p.timestamps if p else ()), (("syslog_timestamp",), "auto")]
    for names, spec in candidates:
        parts = [first(fields, n) for n in names]
        if any(x is None for x in parts):
            continue
        text = " ".join(parts)
        t = parse(text, spec, receipt_ns, offset)
        if t.error is None:
            return t, text
        error = error or (t, text)
    return error or (Time(None), None)


def parse_event(p: Parser | None, text: str, receipt_ns: int, offset: int = 0) -> dict:
    body = st.trim(text)
    if p is None:
        return {"parse_status": "no_parser", "sub_status": "not_applicable", "fields": [("raw_message", body)], "time": Time(None), "time_text": None}
    fields: st.Pairs = []
    if p.syslog:
        fields, body = st.envelope(body)
    status, sub = "parsed", "not_applicable"
    try:
        fields = fields + run_step(p.strategy, body)
        sub = run_subs(p.subs, fields)
    except st.Failed as e:
        status = str(e)
    t, text_ = resolve_time(p, fields, receipt_ns, offset)
    return {"parse_status": status, "sub_status": sub, "fields": fields, "time": t, "time_text": text_}


def spread(raw: DataFrame) -> DataFrame:
    """Events of few and large splits are dealt out, so that all cores parse."""
    cores = raw.sparkSession.sparkContext.defaultParallelism
    if raw.isStreaming or raw.rdd.getNumPartitions() >= cores:
        return raw
    return raw.repartition(2 * cores)


def parse_events(raw: DataFrame, parsers: list[Parser], offset: int = 0, only: list[str] | None = None) -> DataFrame:
    """raw (raw_id, source, receipt_ns, bytes) -> parsed rows; ``only`` keeps some parsers' events.

    Events of the parsers that are not asked for are dropped before any parsing;
    detection still tries all, as an earlier parser may own an event.
    """
    ship(raw.sparkSession)
    by_name = {p.name: p for p in parsers}
    text = latin1(F.col("bytes"))
    found = spread(raw).select("raw_id", "source", "receipt_ns", text.alias("text")).withColumn("parser", detect(F.col("text"), parsers))
    if only is not None:
        found = found.where(F.col("parser").isin(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw_id, source, receipt, t, name in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                r = parse_event(by_name.get(name), t or "", receipt, offset)
                time = r["time"]
                rows.append({"raw_id": raw_id, "source": source, "receipt_ns": receipt, "parser": name, "parse_status": r["parse_status"], "sub_status": r["sub_status"], "fields": [{"k": k, "v": v} for k, v in r["fields"]], "epoch_ns": time.ns, "time_policies": list(time.policies), "time_text": r["time_text"], "time_error": time.error})
            yield _columns(rows, _arrow(PARSED))

    return found.mapInArrow(run, PARSED)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<struct<k:string,v:string>>": pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ", 1) for x in ddl.split(", "))])


# -- normalising ------------------------------------------------------------------


def as_int(text: str) -> int | str:
    """Hexadecimal after 0x, else a strict 64-bit number, else the text itself."""
    try:
        if text[:2] in ("0x", "0X"):
            n = int(text[2:], 16) if text[2:].isalnum() else None
        else:
            digits = text[1:] if text[:1] in "+-" else text
            n = int(text) if digits.isdigit() and digits.isascii() else None
    except ValueError:
        n = None
    return n if n is not None and -(2**63) <= n < 2**63 else text


def lossy(text: str) -> tuple[str, bool]:
    if text.isascii():
        return text, False
    data = text.encode("latin-1")
    try:
        return data.decode(), False
    except UnicodeDecodeError:
        return data.decode(errors="replace"), True


def put(root: dict, path: str, value: object) -> None:
    *parents, last = path.split(".")
    for p in parents:
        if not isinstance(root.get(p), dict):
            root[p] = {}
        root = root[p]
    root[last] = value


def choose(fields: st.Pairs, m: Mapping, low: list[str] | None = None) -> dict[str, int]:
    """For each schema path the field that feeds it: the alias of lowest rank, the first of equals."""
    best: dict[str, tuple[int, int]] = {}
    for i, (k, v) in enumerate(fields):
        hit = m.alias.get(k)
        if hit and (low[i] if low else ascii_lower(v)) not in m.absent_low:
            path, rank = hit
            if path not in best or (rank, i) < best[path]:
                best[path] = (rank, i)
    return {path: i for path, (_, i) in best.items()}


def class_of(fields: st.Pairs, m: Mapping, low: list[str]) -> dict:
    values: dict[str, set[str]] = {}
    for (k, _), v in zip(fields, low, strict=True):
        values.setdefault(k, set()).add(v)

    def holds(key: str, allowed: list[str]) -> bool:
        have = values.get(key, set())
        return any(bool(have - m.absent_low) if a == "*" else ascii_lower(a) in have for a in allowed)

    for c in m.classes:
        if any(all(holds(k, [a] if isinstance(a, str) else a) for k, a in alt.items()) for alt in c.get("when", [])):
            return c
    return m.default_class


def normalize_event(row: dict, m: Mapping, products: dict[str, tuple[str, str]]) -> dict:
    """One parsed event as a schema object, with what its counters need."""
    fields, root, unmapped = row["fields"], {}, []
    low = [ascii_lower(v) for _, v in fields]
    winners = choose(fields, m, low)
    fed = {i: path for path, i in winners.items()}
    enums = {e["field"]: e for e in m.enums}
    bad, missed = False, []
    for i, (k, v) in enumerate(fields):
        if low[i] in m.absent_low:
            continue
        text, odd = lossy(v)
        bad |= odd
        path = fed.get(i)
        if path is None:
            unmapped.append((k, text))
        elif path in enums:
            e = enums[path]
            hit = e["by"].get(k, {}).get(low[i]) or e["table"].get(low[i])
            if hit is None:
                missed.append(path)
                unmapped.append((k, text))
                hit = (e["other"]["value"], e["other"]["id"]) if e.get("other") else None
            if hit:
                put(root, path, hit[0])
                put(root, e["id_field"], hit[1])
        else:
            put(root, path, as_int(text) if path in m.ints else text)
    for path, e in enums.items():
        if path not in winners and e.get("unknown"):
            put(root, path, e["unknown"]["value"])
            put(root, e["id_field"], e["unknown"]["id"])
    c = class_of(fields, m, low)
    if c:
        uid = c.get("uid", 0)
        put(root, "class_uid", uid)
        put(root, "class_name", c.get("name", ""))
        for k in ("category_uid", "category_name"):
            if k in c:
                put(root, k, c[k])
        for k, v in c.get("constants", {}).items():
            put(root, k, v)
        put(root, "type_uid", min(2**63 - 1, uid * 100 + c.get("constants", {}).get("activity_id", 0)))
    ns, policies = row["epoch_ns"], list(row["time_policies"])
    if ns is None:
        ns, policies = row["receipt_ns"], ["receipt_fallback"]
    vendor, product = products.get(row["parser"], ("", ""))
    put(root, "time", ns // 1_000_000)
    put(root, "metadata.product.vendor_name", vendor)
    put(root, "metadata.product.name", product)
    put(root, "metadata.version", m.version)
    put(root, "metadata.processed_time", row["receipt_ns"] // 1_000_000)
    put(root, "metadata.event_time_rfc3339", format_rfc3339(ns))
    put(root, "metadata.log_name", row["source"])
    if row["time_text"] is not None:
        put(root, "metadata.original_time", lossy(row["time_text"])[0])
    trail = {"raw_id": row["raw_id"], "parser": row["parser"], "parse_status": row["parse_status"], "sub_status": row["sub_status"], "time_policies": policies}
    if row["time_error"]:
        trail["time_error"] = row["time_error"]
    if bad:
        trail["utf8_lossy"] = True
    root["pipeline"] = trail
    rest: dict[str, str] = {}
    for k, v in unmapped:
        n, name = 1, lossy(k)[0]
        while (name if n == 1 else f"{name}#{n}") in rest:
            n += 1
        rest[name if n == 1 else f"{name}#{n}"] = v
    if rest:
        root["unmapped"] = rest
    entity = {kind: lossy(fields[winners[path]][1])[0] if path in winners else None for kind, path in ((k, m.entities.get(k)) for k in ENTITY_KINDS)}
    port = as_int(entity["dst_port"]) if entity["dst_port"] else None
    return {
        "raw_id": row["raw_id"], "time": ns // 1_000_000, "class_uid": c.get("uid", 0) if c else 0, "parser": row["parser"], "source": row["source"],
        "parse_status": row["parse_status"], "sub_status": row["sub_status"], "time_policies": policies, "time_error": row["time_error"],
        "normalized": _ENCODE(root), "src_ip": entity["src_ip"], "dst_ip": entity["dst_ip"],
        "user": entity["user"], "dst_port": port if isinstance(port, int) and 0 <= port < 2**31 else None, "device": entity["device"] or row["source"],
        "unmapped_fields": len(rest), "enum_unmapped": len(missed), "utf8_lossy": bad, "enum_miss": missed,
    }


def provenance(fields: st.Pairs, m: Mapping) -> list[tuple[str, int, bool, str]]:
    """(path, field index, canonical, value) of each mapped path; enum misses without ``other`` are left out."""
    enums = {e["field"]: e for e in m.enums}
    out = []
    for path, i in sorted(choose(fields, m).items()):
        k, v = fields[i]
        e = enums.get(path)
        if e is None:
            out.append((path, i, False, lossy(v)[0]))
            continue
        hit = e["by"].get(k, {}).get(ascii_lower(v)) or e["table"].get(ascii_lower(v))
        if hit or e.get("other"):
            out.append((path, i, True, (hit or (e["other"]["value"],))[0]))
    return out


def normalize_events(parsed: DataFrame, m: Mapping, parsers: list[Parser]) -> DataFrame:
    ship(parsed.sparkSession)
    products = {p.name: (p.vendor, p.product) for p in parsers}
    schema = _arrow(NORMALIZED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                row["fields"] = [(x["k"], x["v"]) for x in row["fields"]]
                rows.append(normalize_event(row, m, products))
            yield _columns(rows, schema)

    return parsed.mapInArrow(run, NORMALIZED)


def _columns(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)


def process_events(raw: DataFrame, parsers: list[Parser], m: Mapping, offset: int = 0) -> DataFrame:
    """Raw events straight to normalised ones: what ``parse_events`` and ``normalize_events`` give, in one pass.

    The parsed fields never leave the worker, which spares the costly nested arrays.
    """
    ship(raw.sparkSession)
    by_name = {p.name: p for p in parsers}
    products = {p.name: (p.vendor, p.product) for p in parsers}
    schema = _arrow(NORMALIZED)
    text = latin1(F.col("bytes"))
    found = spread(raw).select("raw_id", "source", "receipt_ns", text.alias("text")).withColumn("parser", detect(F.col("text"), parsers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw_id, source, receipt, t, name in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                r = parse_event(by_name.get(name), t or "", receipt, offset)
                time = r["time"]
                row = {"raw_id": raw_id, "source": source, "receipt_ns": receipt, "parser": name, "epoch_ns": time.ns, "time_policies": time.policies, "time_error": time.error, **r}
                rows.append(normalize_event(row, m, products))
            yield _columns(rows, schema)

    return found.mapInArrow(run, NORMALIZED)
