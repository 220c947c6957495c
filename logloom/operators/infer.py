"""Template inference: groups a source's unknown lines and proposes patterns for them.

Sources are worked on in parallel; within one, lines cluster in id order around
leaders (seeds never move), members are aligned to their leader, and columns that
vary become typed slots.  Proposals only propose: nothing is activated here.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import unified_diff

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._ship import ship
from ..functions.strategies import SLOTS, compile_pattern, pattern_of

BUFFER = 4096  # lines of a source that are held
SIMILAR = 0.6
SUPPORT = 3
LONGEST = 2048  # tokens
TEMPLATES = 40
_ATOMS = [("timestamp", SLOTS["timestamp"]), ("mac", SLOTS["mac"]), ("ipv6", r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}"), ("ipv4", SLOTS["ipv4"]), ("hex", r"0[xX][0-9A-Fa-f]+"), ("float", r"[+-]?[0-9]+\.[0-9]+"), ("int", r"[+-]?[0-9]+(?![A-Za-z0-9_])"), ("quoted", SLOTS["quoted"]), ("word", r"[A-Za-z0-9_\-]+"), ("space", r"[ \t]+"), ("punct", r"(?s).")]
TOKEN = re.compile("|".join(f"(?P<{k}>{e.replace('(?s)', '')})" for k, e in _ATOMS), re.S)


def tokenize(line: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0]) for m in TOKEN.finditer(line)]


def lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, the earliest choices first."""
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if k:
        return [(i, i) for i in range(k)] + [(i + k, j + k) for i, j in lcs(a[k:], b[k:])]
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def lcs_length(a: list, b: list) -> int:
    """Length of a longest common subsequence; a row of the table is one integer's bits."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def shape(tokens: list[tuple[str, str]]) -> list[str]:
    """Words stand for themselves, values for their kind."""
    return [v if k in ("word", "punct") else k for k, v in tokens if k != "space"]


def similarity(a: list[str], b: list[str]) -> float:
    full = 2 * lcs_length(a, b) / max(1, len(a) + len(b))
    head = 2 * lcs_length(a[:6], b[:6]) / max(1, len(a[:6]) + len(b[:6]))
    return max(full, head)


def _merge(common: list[tuple], other: list[tuple[str, str]]) -> list[tuple]:
    """What both share, with an open token wherever they differ."""
    pairs = lcs([v if k in ("word", "punct", "space") else k for k, v in common], [v if k in ("word", "punct", "space") else k for k, v in other])
    merged, i, j = [], 0, 0
    for x, y in [*pairs, (len(common), len(other))]:
        gap = common[i:x] + other[j:y]
        if gap:
            kinds = {k for k, _ in gap}
            kind = gap[0][0] if len(kinds) == 1 and gap[0][0] not in ("space", "punct") and len(common[i:x]) == len(other[j:y]) == 1 else "text"
            merged.append((kind, None))
        if x < len(common):
            merged.append(common[x] if common[x][1] == other[y][1] else (common[x][0], None))
        i, j = x + 1, y + 1
    return [t for n, t in enumerate(merged) if not (n and t == ("text", None) == merged[n - 1])]


def template(lines: list[list[tuple[str, str]]]) -> list[tuple]:
    """Constants all lines share, in order, with a typed slot wherever something differs.

    Every line is looked at; one that the pattern so far reads has nothing to add.
    """
    common: list[tuple] = lines[0]
    reads = compile_pattern(pattern_of(_slots(common)), "full")[0]
    for other in lines[1:]:
        if reads.search("".join(v for _, v in other)):
            continue
        merged = _merge(common, other)
        if merged != common:
            common = merged
            reads = compile_pattern(pattern_of(_slots(common)), "full")[0]
    return _slots(common)


def _slots(common: list[tuple]) -> list[tuple]:
    """Text and named slots of merged tokens."""
    out: list[tuple] = []
    names: Counter[str] = Counter()
    for kind, value in common:
        if value is not None:
            if out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + value)
            else:
                out.append(("text", value))
            continue
        if out and out[-1][0] == "slot" and out[-1][2] == "text":
            continue
        before = re.search(r"([A-Za-z][A-Za-z0-9_]*)[=:]?[ \"]*$", out[-1][1]) if out and out[-1][0] == "text" else None
        base = before[1].lower() if before else {"ipv4": "ip", "ipv6": "ip"}.get(kind, kind)
        names[base] += 1
        out.append(("slot", base if names[base] == 1 else f"{base}_{names[base]}", {"space": "text", "punct": "text"}.get(kind, kind)))
    return out


def infer_lines(lines: list[str], support: int = SUPPORT) -> tuple[list[tuple[str, int, int]], Counter[str]]:
    """((pattern, lines that made it, lines it reads) ..., reasons of lines that no pattern reads)."""
    reasons: Counter[str] = Counter()
    clusters: list[tuple[list[str], list[list[tuple[str, str]]]]] = []
    kept: list[str] = []
    for line in lines:
        line = line.rstrip("\r\n")
        if not line.strip():
            reasons["empty"] += 1
            continue
        if line.startswith("#"):
            reasons["header"] += 1
            continue
        tokens = tokenize(line)
        if len(tokens) > LONGEST:
            reasons["too_long"] += 1
            continue
        kept.append(line)
        s = shape(tokens)
        best = max(((similarity(s, seed), -n) for n, (seed, _) in enumerate(clusters)), default=(0, 0))
        if best[0] >= SIMILAR:
            clusters[-best[1]][1].append(tokens)
        else:
            clusters.append((s, [tokens]))
    found: dict[str, int] = {}
    for _, members in clusters:
        if len(members) < support:
            reasons["below_support"] += len(members)
            continue
        p = pattern_of(template(members))
        found[p] = found.get(p, 0) + len(members)
    constant = lambda p: len(re.sub(r"\{[^}]*\}", "", p))
    order = sorted(found, key=lambda p: (-constant(p), p))[:TEMPLATES]
    reads: Counter[str] = Counter()
    for line in kept:
        for p in order:
            if compile_pattern(p, "full")[0].search(line):
                reads[p] += 1
                break
        else:
            reasons["no_template"] += 1
    return [(p, found[p], reads[p]) for p in order], reasons


def fingerprint(patterns: list[str]) -> str:
    """64-bit FNV-1a over the patterns, each closed by a zero byte, as hex."""
    h = 0xCBF29CE484222325
    for p in patterns:
        for b in p.encode() + b"\0":
            h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def slug(name: str) -> str:
    """A definition's name from a source's: base name, no .log or .txt, other characters to single underscores."""
    base = re.sub(r"\.(log|txt)$", "", name.rpartition("/")[2])
    return re.sub(r"[^A-Za-z0-9]+", "_", base).strip("_").lower()


def definition(source: str, patterns: list[str], version: int = 1) -> str:
    """The proposal as a definition file's text."""
    lead = max((w for p in patterns[:1] for w in re.findall(r"[A-Za-z]{3,}", re.sub(r"\{[^}]*\}", " ", p))), key=len, default=None)
    match = f"contains = [{lead!r}]" if lead else 'regex = "."'
    body = ",\n  ".join("'''" + p + "'''" for p in patterns)
    return f'[parser]\nname = "{slug(source)}"\nvendor = ""\nproduct = "inferred v{version}"\npriority = -1\n\n[match]\n{match}\n\n[strategy]\nkind = "pattern"\npatterns = [\n  {body},\n]\n'.replace("contains = ['", 'contains = ["').replace("']\n\n[strategy]", '"]\n\n[strategy]')


def changes(old: str, new: str) -> str:
    """Unified diff of two definition texts."""
    return "\n".join(unified_diff(old.splitlines(), new.splitlines(), "current", "proposed", lineterm=""))


def infer_templates(lines: DataFrame, support: int = SUPPORT, buffer: int = BUFFER) -> DataFrame:
    """(source, pattern, support, verified, fingerprint, definition) from (source, raw_id, line).

    The first ``buffer`` lines of a source by id are worked on, as in a live buffer.
    """
    ship(lines.sparkSession)
    first = Window.partitionBy("source").orderBy("raw_id")
    held = lines.withColumn("n", F.row_number().over(first)).where(F.col("n") <= buffer).select("source", "raw_id", "line")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("raw_id")
        found, _ = infer_lines(pdf.line.tolist(), support)
        patterns = [p for p, _, _ in found]
        rows = [(pdf.source.iloc[0], p, n, v, fingerprint(patterns), definition(pdf.source.iloc[0], patterns)) for p, n, v in found]
        return pd.DataFrame(rows, columns=["source", "pattern", "support", "verified", "fingerprint", "definition"])

    return held.groupBy("source").applyInPandas(run, "source string, pattern string, support long, verified long, fingerprint string, definition string")

