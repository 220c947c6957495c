"""The engine as a caller sees it: ingest, query, replay, verify, review.

State is a folder of Parquet tables: ``raw``, ``chain``, ``normalized/version=N``.
All methods give DataFrames unless they say otherwise.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analytics as an
from .operators import framing, store
from .operators.review import Review
from .plans.definitions import HERE, load_mapping, load_parsers
from .plans.pipeline import latin1, parse_event, process_events, provenance
from .streaming.syslog import unemitted


@dataclass
class Engine:
    spark: SparkSession
    root: str
    parsers_dir: str = str(HERE / "parsers")
    schema: str = "ocsf"
    offset: int = 0  # seconds, for stamps without a zone
    parsers: list = field(default_factory=list)
    problems: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.reload()

    # -- definitions ------------------------------------------------------------

    def reload(self) -> list[str]:
        """Reads all definitions again; the problems found."""
        self.parsers, bad = load_parsers(self.parsers_dir)
        self.mapping, more = load_mapping(self.schema)
        self.problems = bad + more
        return self.problems

    check = reload

    def status(self) -> dict:
        return {"root": self.root, "schema": self.schema, "parsers": [p.name for p in self.parsers], "problems": self.problems, "versions": self.versions()}

    def review(self) -> Review:
        return Review(self.spark, f"{self.root}/pending", self.parsers_dir)

    # -- tables -------------------------------------------------------------------

    def raw(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/raw")

    def versions(self) -> list[int]:
        folder = Path(self.root) / "normalized"
        return sorted(int(p.name.partition("=")[2]) for p in folder.glob("version=*"))

    def events(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/normalized/version={version or max(self.versions())}")

    # -- ingest -------------------------------------------------------------------

    def ingest(self, folder: str, include: tuple[str, ...] = (), receipt_ns: int | None = None) -> int:
        """Frames, stores and normalises the files of a folder; the number of events."""
        self.recover()
        files = framing.read_files(self.spark, folder, include)
        framed = framing.frame(files.select("source", latin1(F.col("content")).alias("text")))
        first = 0
        if (Path(self.root) / "raw").exists():
            first = self.raw().agg(F.max("raw_id")).first()[0] + 1
        now = receipt_ns if receipt_ns is not None else time.time_ns()
        rows = store.dense_ids(framed, ["source", "pos"], first)
        rows = rows.select("raw_id", "source", F.lit(now).alias("receipt_ns"), F.encode("event", "ISO-8859-1").alias("bytes"))
        rows = rows.withColumn("sha256", store.digest(F.col("bytes")))
        rows.sortWithinPartitions("raw_id").write.mode("append").parquet(f"{self.root}/raw")
        self.recover()
        return self.raw().where(F.col("raw_id") >= first).count()

    def recover(self) -> None:
        """Chains and normalises what is stored and lacks it: the end of an ingest, or what one that broke off left.

        New events go to the version that readers see.
        """
        if not (Path(self.root) / "raw").exists():
            return
        raw, last, head = self.raw(), None, store.genesis(self.root)
        if (Path(self.root) / "chain").exists():
            last = self.spark.read.parquet(f"{self.root}/chain").orderBy(F.desc("raw_id")).first()
        if last is not None:
            head = bytes(last["chain"])
        links = store.chain(raw if last is None else raw.where(F.col("raw_id") > last["raw_id"]), head)
        if links is not None:
            links.select("raw_id", "chain").write.mode("append").parquet(f"{self.root}/chain")
        version = max(self.versions(), default=1)
        missing = unemitted(raw, self.events(version)) if self.versions() else raw
        self._normalize(missing).write.mode("append").parquet(f"{self.root}/normalized/version={version}")

    def _normalize(self, raw: DataFrame) -> DataFrame:
        return process_events(raw, self.parsers, self.mapping, self.offset)

    def records(self) -> DataFrame:
        return self.raw().join(self.spark.read.parquet(f"{self.root}/chain"), "raw_id")

    # -- queries --------------------------------------------------------------------

    def metrics(self, version: int | None = None) -> DataFrame:
        return an.counters(self.events(version))

    def sources(self) -> DataFrame:
        return an.source_stats(self.events())

    def tail(self, after: int = -1, limit: int = 100) -> DataFrame:
        return an.tail(self.events(), after, limit)

    def export(self, low: int, high: int, terms: list[str] | None = None) -> DataFrame:
        return an.export(self.events(), low, high, terms or [])

    def entities(self, kind: str, prefix: str = "", limit: int = 50) -> DataFrame:
        return an.top_entities(an.postings(self.events()), kind, prefix, limit)

    def pivot(self, kind: str, value: str, limit: int = 200, before: tuple[int, int] | None = None, ascending: bool = False) -> dict[str, DataFrame]:
        """header, devices, a page of events and related values of an entity."""
        posts = an.postings(self.events())
        page = an.timeline(posts, kind, value, limit, before, ascending)
        header = an.entity_summary(posts.where((F.col("kind") == kind) & (F.col("value") == value)))
        return {"header": header, "devices": an.devices_of(posts, kind, value), "events": page.join(self.events().select("raw_id", "normalized"), "raw_id"), "related": an.related(posts, kind, value)}

    def parser_hits(self) -> DataFrame:
        return an.parser_hits(self.events())

    def source_parsers(self) -> DataFrame:
        return an.source_parsers(self.events())

    def trust_flags(self) -> DataFrame:
        return an.trust_flags(self.events())

    def drift_alerts(self) -> DataFrame:
        e = self.events()
        if (Path(self.root) / "cleared").exists():
            e = an.since_clear(e, self.spark.read.parquet(f"{self.root}/cleared"))
        windows = an.drift_windows(e, F.col("source"), F.col("parse_status") != "parsed", "raw_id")
        return an.drift_states(windows).orderBy(F.desc("tripped"), "source")

    def clear_drift(self, source: str) -> None:
        """A source whose update was approved or rejected starts a fresh baseline after its events so far."""
        last = self.events().where(F.col("source") == source).groupBy("source").agg(F.max("raw_id").alias("raw_id"))
        last.coalesce(1).write.mode("append").parquet(f"{self.root}/cleared")

    def traceback(self, raw_id: int) -> dict:
        """One event from its bytes to its emitted line, with fields and provenance."""
        row = self.records().where(F.col("raw_id") == raw_id).first()
        if row is None:
            raise KeyError(raw_id)
        emitted = self.events().where(F.col("raw_id") == raw_id).first()
        p = next((x for x in self.parsers if emitted and x.name == emitted["parser"]), None)
        text = bytes(row["bytes"]).decode("latin-1")
        again = parse_event(p, text, row["receipt_ns"], self.offset)
        shown = "".join(c if c in "\n\t" or " " <= c != "\x7f" else f"\\x{ord(c):02x}" for c in text)
        return {
            "raw_id": raw_id, "source": row["source"], "sha256": bytes(row["sha256"]).hex(), "chain": bytes(row["chain"]).hex(), "text": shown, "fields": again["fields"],
            "provenance": provenance(again["fields"], self.mapping), "line": emitted["normalized"] if emitted else None,
        }

    # -- replay -----------------------------------------------------------------------

    def replay(self) -> int:
        """All of history with the definitions of now, as a new version; its number."""
        version = max(self.versions(), default=0) + 1
        self._normalize(self.raw()).write.mode("error").parquet(f"{self.root}/normalized/version={version}")
        return version

    def diff(self, old: int, new: int) -> DataFrame:
        return an.replay_diff(self.events(old), self.events(new))

    def diff_page(self, old: int, new: int, after: int = -1, limit: int = 100, kind: str | None = None) -> DataFrame:
        d = self.diff(old, new).where(F.col("raw_id") > after)
        d = d.where(F.col("change") == kind) if kind else d.where("change <> 'unchanged'")
        return d.orderBy("raw_id").limit(limit)

    # -- integrity ----------------------------------------------------------------------

    def verify(self) -> DataFrame:
        return store.verify(self.records(), store.genesis(self.root))

    def attest(self) -> DataFrame:
        return store.attest(self.records().select("raw_id", "sha256", "chain"))

    def infer(self) -> int:
        """Proposals for events that no parser owns and, of sources that have drifted, for those that failed since."""
        unknown = an.routed(self.events(), self.drift_alerts()).select("raw_id", "source")
        return self.review().propose(self.raw().join(unknown, ["raw_id", "source"]).select("source", "raw_id", latin1(F.col("bytes")).alias("line")))
