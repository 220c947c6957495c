"""Syslog framing for streams, and streaming plans over growing folders."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.framing import split_complete


def tcp_frames(data: bytes, eof: bool = False) -> tuple[list[bytes], bytes]:
    """Events of a TCP connection and the bytes that are left.

    A stream whose first bytes are a length and a blank counts octets; a frame
    that is no length falls back to lines.  At the end what is left is one event.
    """
    out: list[bytes] = []
    while data:
        head = re.match(rb"([1-9][0-9]{0,8}) ", data)
        if head:
            n = int(head[1])
            if len(data) < head.end() + n:
                break
            out.append(data[head.end() : head.end() + n])
            data = data[head.end() + n :]
            continue
        if not eof and re.fullmatch(rb"[1-9][0-9]{0,8}", data):
            break
        events, rest = split_complete(data.decode("latin-1"), eof)
        out += [e.encode("latin-1") for e in events]
        data = rest.encode("latin-1")
        break
    if eof and data:
        out.append(data)
        data = b""
    return out, data


def udp_event(datagram: bytes, peer: str) -> tuple[str, bytes]:
    """One datagram is one event of the peer's source."""
    return f"udp/{peer}", datagram


def tail_folder(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the events of new files; admission is bounded, nothing is dropped."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    read = files.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    text = F.decode("content", "ISO-8859-1")
    events = F.filter(F.split(text, r"(?<=\n)(?![ \t\r\n])"), lambda x: x != "")
    out = read.select(F.element_at(F.split("path", "/"), -1).alias("source"), (F.unix_micros(F.current_timestamp()) * 1000).alias("receipt_ns"), F.posexplode(events).alias("pos", "event"))
    return out.withColumn("bytes", F.encode("event", "ISO-8859-1")).drop("event")


def serve(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs ``plan`` on every micro-batch, so that changed definitions take effect between batches."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: sink(plan(df), i))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="250 milliseconds")).start()


def unemitted(raw: DataFrame, normalized: DataFrame) -> DataFrame:
    """Stored events that were never written out: what a restart does first."""
    return raw.join(normalized.select("raw_id"), "raw_id", "left_anti")
