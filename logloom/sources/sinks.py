"""Sinks: JSON Lines in id order, Parquet, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("raw_id", "time", "parser", "source", "class_uid", "normalized", "src_ip", "dst_ip", "user", "device", "dst_port")
ROLL_ROWS = 1_000_000


def write_jsonl(events: DataFrame, path: str, key: str = "raw_id") -> None:
    """One line an event; files and the lines in them rise by id."""
    events.repartitionByRange(key).sortWithinPartitions(key).select("normalized").write.mode("error").text(path)


def write_parquet(events: DataFrame, path: str, roll: int = ROLL_ROWS) -> None:
    """Snappy Parquet of the promoted columns, sorted so that id ranges prune row groups."""
    out = events.select(*COLUMNS).repartitionByRange("raw_id").sortWithinPartitions("raw_id")
    out.write.mode("error").option("compression", "snappy").option("maxRecordsPerFile", roll).parquet(path)


def csv_lines(events: DataFrame) -> DataFrame:
    """RFC 4180 lines: fields with a quote, comma or line end are quoted, quotes doubled."""

    def cell(c: str):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return events.select("raw_id", F.concat_ws(",", *[cell(c) for c in COLUMNS]).alias("line"))
