"""Framing: bytes to events.  A line and the lines after it that start with white space are one event."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: An event ends after a newline that no continuation follows.
BOUNDARY = r"(?<=\n)(?![ \t\r\n])"
#: Files that a folder scan leaves out unless they are named.
EXCLUDES = ("*.md", "README*", ".*", "*.truth.tsv", "*.expected.jsonl")


def glob_regex(pattern: str) -> str:
    """``*`` stays in a folder, ``**`` does not, ``?`` is one character; a bare name matches at any depth."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            i += 1
    body = "".join(out)
    return f"^(?:.*/)?{body}$" if "/" not in pattern else f"^{body}$"


def glob_match(pattern: str, path: str) -> bool:
    return re.match(glob_regex(pattern), path) is not None


def read_files(spark: SparkSession, root: str, include: Iterable[str] = (), exclude: Iterable[str] = EXCLUDES) -> DataFrame:
    """source (path below the root) and content of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.substring_index("path", root.rstrip("/") + "/", -1)
    out = files.select(path.alias("source"), "content")
    wanted = F.lit(True)
    if include:
        wanted = F.lit(False)
        for p in include:
            wanted = wanted | F.col("source").rlike(glob_regex(p))
    for p in exclude:
        # an excluded folder takes what is below it along
        wanted = wanted & ~F.col("source").rlike(glob_regex(p).replace("$", "(?:/.*)?$"))
    return out.where(wanted)


def frame(files: DataFrame, key: str = "source", content: str = "text") -> DataFrame:
    """(key, pos, event) of whole texts; the events of a text concatenate to it.

    Text is Latin-1 for bytes.  One narrow expression, no shuffle.
    """
    events = F.filter(F.split(F.col(content), BOUNDARY), lambda x: x != "")
    return files.select(key, F.posexplode(events).alias("pos", "event"))


def frame_lines(lines: DataFrame, key: str = "source", order: str = "line_no", line: str = "line") -> DataFrame:
    """The same for files too large for one row: lines (with their newlines) grouped by gaps and islands."""
    w = Window.partitionBy(key).orderBy(order)
    starts = ~F.col(line).rlike(r"^[ \t\r\n]") | (F.row_number().over(w) == 1)
    run = lines.withColumn("island", F.sum(starts.cast("int")).over(w))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(line))))
    joined = F.array_join(F.transform(parts, lambda x: x[line]), "")
    return run.groupBy(key, "island").agg(joined.alias("event")).select(key, (F.col("island") - 1).cast("int").alias("pos"), "event")


def split_complete(text: str, eof: bool) -> tuple[list[str], str]:
    """Events whose end is certain and what is left; at the end of input everything is."""
    parts = [x for x in re.split(BOUNDARY, text) if x]
    if eof or not parts:
        return parts, ""
    return parts[:-1], parts[-1]
