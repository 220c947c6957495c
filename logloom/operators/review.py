"""Review of proposed definitions: nothing takes effect before a person approves it.

Proposals and decisions are small tables (one row a source), kept as rows in a
Parquet folder; every change adds rows, and the newest row of a proposal counts.
"""

from __future__ import annotations

import re
import time
import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.definitions import Invalid, parser_of
from .infer import changes, fingerprint, infer_templates

SCHEMA = "id string, source string, state string, fingerprint string, definition string, version int, at long"
NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")


@dataclass
class Review:
    spark: SparkSession
    table: str
    parsers: str

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.table)
        except Exception:  # nothing has been proposed yet
            return self.spark.createDataFrame([], SCHEMA)

    def current(self) -> DataFrame:
        newest = Window.partitionBy("id").orderBy(F.desc("at"))
        return self.rows().withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")

    def _add(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.table)

    def propose(self, lines: DataFrame) -> int:
        """Infers from (source, raw_id, line); fingerprints that were rejected for a source do not come back."""
        found = infer_templates(lines).groupBy("source").agg(F.first("fingerprint").alias("f"), F.first("definition").alias("d"))
        gone = self.rows().where("state = 'rejected'").select("source", F.col("fingerprint").alias("f")).distinct()
        fresh = found.join(gone, ["source", "f"], "left_anti").collect()  # one row a source
        now = time.time_ns()
        self._add([(r.source, r.source, "pending", r.f, r.d, 1, now) for r in fresh])
        return len(fresh)

    def pending(self) -> DataFrame:
        return self.current().where("state = 'pending'").orderBy("id")

    def get(self, key: str) -> dict:
        row = self.current().where(F.col("id") == key).first()
        if row is None:
            raise KeyError(key)
        return row.asDict()

    def edit(self, key: str, definition: str) -> dict:
        """A changed text must still be a definition."""
        row = self.get(key)
        parser_of(tomllib.loads(definition))
        patterns = tomllib.loads(definition)["strategy"].get("patterns", [])
        self._add([(key, row["source"], "pending", fingerprint(patterns), definition, row["version"] + 1, time.time_ns())])
        return self.get(key)

    def diff(self, key: str) -> str:
        row = self.get(key)
        name = tomllib.loads(row["definition"])["parser"]["name"]
        path = Path(self.parsers) / f"{name}.toml"
        return changes(path.read_text() if path.exists() else "", row["definition"])

    def approve(self, key: str) -> Path:
        """Writes the definition where parsers are loaded from; a replaced one is kept beside it."""
        row = self.get(key)
        name = parser_of(tomllib.loads(row["definition"])).name
        if not NAME.fullmatch(name):
            raise Invalid(f"bad name {name!r}")
        path = Path(self.parsers) / f"{name}.toml"
        if path.exists():
            path.rename(path.with_suffix(f".toml.{time.time_ns()}.old"))
        path.write_text(row["definition"])
        self._add([(key, row["source"], "approved", row["fingerprint"], row["definition"], row["version"], time.time_ns())])
        return path

    def reject(self, key: str) -> None:
        row = self.get(key)
        self._add([(key, row["source"], "rejected", row["fingerprint"], row["definition"], row["version"], time.time_ns())])
