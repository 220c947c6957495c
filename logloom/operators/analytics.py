"""Counters, entities, pivots, paging, replay diffs, drift windows and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATED = 10_000  # newest events of an entity whose other entities count as related
WINDOW = 512
#: When a source's parser counts as established, and when it has drifted.
BASELINE_EVENTS, BASELINE_RATE, TRIP_MISSES, TRIP_RISE, CLEAN = 1024, 0.2, 32, 0.25, 4


# -- counters -----------------------------------------------------------------------


def counters(events: DataFrame) -> DataFrame:
    """One row of sums over per-event outcomes; partial sums on every task."""
    return events.agg(
        F.count("*").alias("events"),
        F.count_if(F.col("parser").isNotNull()).alias("detected"),
        F.count_if(F.col("parse_status") == "no_parser").alias("no_parser"),
        F.count_if(~F.col("parse_status").isin("parsed", "no_parser")).alias("parse_failed"),
        F.count_if(F.col("sub_status") == "uncovered").alias("sub_uncovered"),
        F.count_if(F.col("sub_status") == "no_match").alias("sub_no_match"),
        F.count_if(F.array_contains("time_policies", "receipt_fallback")).alias("time_from_receipt"),
        F.count_if(F.col("class_uid") == 0).alias("class_unknown"),
        F.coalesce(F.sum("unmapped_fields"), F.lit(0)).alias("unmapped_fields"),
        F.coalesce(F.sum("enum_unmapped"), F.lit(0)).alias("enum_unmapped"),
        F.count_if(F.col("utf8_lossy")).alias("utf8_lossy"),
    )


def by_reason(events: DataFrame, column: str) -> DataFrame:
    return events.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("events"))


def source_stats(events: DataFrame) -> DataFrame:
    """Per source: counts, last event and the parser that read most (of equals the last by name)."""
    per = events.groupBy("source", "parser").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("parse_status") == "no_parser").alias("no_parser"),
        F.count_if(~F.col("parse_status").isin("parsed", "no_parser")).alias("failed"),
        F.max("time").alias("last"),
    )
    best = F.max_by("parser", F.when(F.col("parser").isNotNull(), F.struct("n", "parser")))
    return per.groupBy("source").agg(
        F.sum("n").alias("events"), F.sum("no_parser").alias("no_parser"), F.sum("failed").alias("parse_failed"), F.max("last").alias("last_seen"), best.alias("established")
    )


def parser_hits(events: DataFrame) -> DataFrame:
    """(parser, events): how many events each parser owns."""
    return by_reason(events, "parser")


def source_parsers(events: DataFrame) -> DataFrame:
    """(source, parser, events): a source's events by the parser that owns them."""
    return events.where(F.col("parser").isNotNull()).groupBy("source", "parser").agg(F.count("*").alias("events"))


def trust_flags(events: DataFrame) -> DataFrame:
    """The outcome flags of each event; ``unmapped`` is a number of fields.  Their sums are the counters."""
    return events.select(
        "raw_id",
        (F.col("parse_status") == "no_parser").alias("no_parser"),
        (~F.col("parse_status").isin("parsed", "no_parser")).alias("parse_failed"),
        (F.col("sub_status") == "uncovered").alias("sub_uncovered"),
        (F.col("sub_status") == "no_match").alias("sub_no_match"),
        F.array_contains("time_policies", "receipt_fallback").alias("time_from_receipt"),
        F.col("time_error").isNotNull().alias("time_error"),
        (F.col("class_uid") == 0).alias("class_unknown"),
        F.col("unmapped_fields").alias("unmapped"),
        "utf8_lossy",
    )


def look_up(rows: DataFrame, entries: DataFrame, key: str, entry_key: str, required: bool = True) -> DataFrame:
    """Rows with their dictionary entry; those without one go, or stay with nulls if it is not ``required``.

    The dictionary is broadcast only where its size as known to the planner allows it.
    """
    return rows.join(entries, rows[key] == entries[entry_key], "inner" if required else "left")


# -- entities -----------------------------------------------------------------------


def postings(normalized: DataFrame) -> DataFrame:
    """(kind, value, raw_id, time, device, parser) of every entity of every event: one stack, no shuffle."""
    kinds = [("src_ip", "src_ip"), ("dst_ip", "dst_ip"), ("user", "user"), ("dst_port", "dst_port"), ("device", "device")]
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds])
    out = normalized.select(F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("e"), "raw_id", "time", F.col("device").alias("device_"), "parser")
    return out.select("e.kind", "e.value", "raw_id", "time", F.col("device_").alias("device"), "parser")


def entity_summary(posts: DataFrame) -> DataFrame:
    return posts.groupBy("kind", "value").agg(F.count("*").alias("events"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.count_distinct("device").alias("devices"))


def top_entities(posts: DataFrame, kind: str, prefix: str = "", limit: int = 50) -> DataFrame:
    """Most frequent values of a kind, ties by value."""
    own = posts.where((F.col("kind") == kind) & F.col("value").startswith(prefix))
    return own.groupBy("value").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "value").limit(max(1, min(limit, 1000)))


def devices_of(posts: DataFrame, kind: str, value: str) -> DataFrame:
    own = posts.where((F.col("kind") == kind) & (F.col("value") == value))
    return own.groupBy("device").agg(F.count("*").alias("events"), F.array_sort(F.collect_set("parser")).alias("parsers"))


def timeline(posts: DataFrame, kind: str, value: str, limit: int = 200, before: tuple[int, int] | None = None, ascending: bool = False) -> DataFrame:
    """A page of an entity's events by (time, id), after or before a cursor."""
    own = posts.where((F.col("kind") == kind) & (F.col("value") == value))
    return keyset_page(own, ["time", "raw_id"], limit, before, ascending)


def keyset_page(rows: DataFrame, keys: list[str], limit: int, cursor: tuple | None = None, ascending: bool = False) -> DataFrame:
    if cursor is not None:
        here = F.struct(*[F.col(k) for k in keys])
        there = F.struct(*[F.lit(c).cast(rows.schema[k].dataType).alias(k) for k, c in zip(keys, cursor, strict=True)])
        rows = rows.where(here > there if ascending else here < there)
    order = [F.col(k).asc() if ascending else F.col(k).desc() for k in keys]
    return rows.orderBy(*order).limit(max(1, min(limit, 500)))


def related(posts: DataFrame, kind: str, value: str, top: int = 10, window: int = RELATED) -> DataFrame:
    """Per other kind the values that most often share one of the entity's newest events."""
    newest = posts.where((F.col("kind") == kind) & (F.col("value") == value)).select("time", "raw_id").orderBy(F.desc("time"), F.desc("raw_id")).limit(window)
    # at most ``window`` ids, so they may be broadcast
    others = posts.where(F.col("kind") != kind).join(F.broadcast(newest.select("raw_id")), "raw_id", "left_semi")
    n = others.groupBy("kind", "value").agg(F.count("*").alias("events"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("events"), "value"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top)


# -- tail and export ------------------------------------------------------------------


def tail(events: DataFrame, after: int, limit: int, ring: int = 1000, key: str = "raw_id") -> DataFrame:
    """The newest ``limit`` of the last ``ring`` events after an id, in order."""
    newest = events.orderBy(F.desc(key)).limit(ring).where(F.col(key) > after)
    return newest.orderBy(F.desc(key)).limit(limit).orderBy(key)


def export(events: DataFrame, low: int, high: int, terms: list[str], line: str = "normalized", key: str = "raw_id") -> DataFrame:
    """Rows of an id range whose line holds every term, whatever the case of A-Z."""
    out = events.where(F.col(key).between(low, high))
    lowered = ascii_lower(F.col(line))
    for t in terms:
        out = out.where(F.instr(lowered, ascii_lower_text(t)) > 0)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower_text(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# -- replay ---------------------------------------------------------------------------


def replay_diff(old: DataFrame, new: DataFrame, key: str = "raw_id", line: str = "normalized") -> DataFrame:
    """unchanged, changed, only_in_old or only_in_new of every id of two versions."""
    a, b = old.select(key, F.col(line).alias("old")), new.select(key, F.col(line).alias("new"))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), key, "full")
    change = F.when(F.col("b").isNull(), "only_in_old").when(F.col("a").isNull(), "only_in_new").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"), "old", "new")


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, path, change, old, new): fields added, lost or changed between two versions of a row."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("v")) for f in fields])
        return df.select(key, F.explode(pairs).alias("x")).select(key, "x.path", F.col("x.v").alias(name)).where(F.col(name).isNotNull())

    both = long(old, "old").join(long(new, "new"), [key, "path"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "lost").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "path", change.alias("change"), "old", "new")


def diff_summary(diff: DataFrame, top: int = 200) -> DataFrame:
    return diff.groupBy("path", "change").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "path", "change").limit(top)


# -- drift ----------------------------------------------------------------------------


def drift_windows(events: DataFrame, source: Column, missed: Column, order: str, size: int = WINDOW) -> DataFrame:
    """(source, window, events, misses, last, full): fixed numbers of events of each source in order; last: the last one's place."""
    w = Window.partitionBy("source").orderBy(order)
    n = events.select(source.alias("source"), missed.alias("missed"), order).withColumn("window", F.floor((F.row_number().over(w) - 1) / size))
    out = n.groupBy("source", "window").agg(F.count("*").alias("events"), F.count_if("missed").alias("misses"), F.max(order).cast("long").alias("last"))
    return out.withColumn("full", F.col("events") == size)


def drift_states(windows: DataFrame) -> DataFrame:
    """Folds each source's full windows in order: tripped or not, since which event, baseline and clean windows at the end."""
    state = "named_struct('tripped', false, 'trips', 0, 'clean', 0, 'n', 0L, 'm', 0L, 'since', CAST(NULL AS BIGINT))"
    last = "last" if "last" in windows.columns else F.lit(None).cast("long").alias("last")
    seq = windows.where("full").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("window", "events", "misses", last))).alias("w"))
    fold = f"""
      aggregate(w, {state}, (s, x) ->
        CASE WHEN s.tripped AND x.misses / x.events < s.m / greatest(s.n, 1L) + {TRIP_RISE} THEN
               CASE WHEN s.clean + 1 >= {CLEAN} THEN named_struct('tripped', false, 'trips', s.trips, 'clean', 0, 'n', 0L, 'm', 0L, 'since', CAST(NULL AS BIGINT))
                    ELSE named_struct('tripped', true, 'trips', s.trips, 'clean', s.clean + 1, 'n', s.n, 'm', s.m, 'since', s.since) END
             WHEN s.tripped THEN named_struct('tripped', true, 'trips', s.trips, 'clean', 0, 'n', s.n, 'm', s.m, 'since', s.since)
             WHEN s.n >= {BASELINE_EVENTS} AND s.m / s.n < {BASELINE_RATE} AND x.misses >= {TRIP_MISSES} AND x.misses / x.events >= s.m / s.n + {TRIP_RISE}
               THEN named_struct('tripped', true, 'trips', s.trips + 1, 'clean', 0, 'n', s.n, 'm', s.m, 'since', x.last)
             ELSE named_struct('tripped', false, 'trips', s.trips, 'clean', 0, 'n', s.n + x.events, 'm', s.m + x.misses, 'since', s.since) END)"""
    return seq.select("source", F.expr(fold).alias("s")).select("source", "s.tripped", "s.trips", "s.clean", F.col("s.n").alias("baseline_events"), F.col("s.m").alias("baseline_misses"), "s.since")


def routed(events: DataFrame, states: DataFrame) -> DataFrame:
    """The events that inference gets: those without a parser, and of tripped sources those that failed after the trip."""
    since = states.where("tripped").select("source", "since")
    met = events.join(since, "source", "left")
    failed = ~F.col("parse_status").isin("parsed", "no_parser")
    return met.where((F.col("parse_status") == "no_parser") | (failed & (F.col("raw_id") > F.col("since")))).select(*events.columns)


def since_clear(events: DataFrame, cleared: DataFrame) -> DataFrame:
    """Events after their source's last cleared one; sources never cleared keep all."""
    until = cleared.groupBy("source").agg(F.max("raw_id").alias("until"))
    met = events.join(until, "source", "left")
    return met.where(F.col("until").isNull() | (F.col("raw_id") > F.col("until"))).select(*events.columns)
