"""Parser and mapping definitions: TOML files, checked on the driver, one error never stops the rest."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.strategies import compile_pattern, compile_regex
from ..functions.timestamps import layout

HERE = Path(__file__).resolve().parents[1] / "definitions"
#: Keys that each kind of strategy knows.
KEYS = {
    "kv": {"key_value_separator", "pair_separator", "quote"},
    "delimiter": {"delimiter", "fields", "rest", "quote"},
    "json": set(), "cef": set(), "leef": set(), "xml": set(),
    "pattern": {"patterns", "regexes", "anchor"},
}
ENTITY_KINDS = ("src_ip", "dst_ip", "user", "dst_port", "device")
LARGEST_UID = 99_999_999


class Invalid(Exception):
    pass


@dataclass(frozen=True)
class Step:
    """A strategy, or a sub-parser of one field with its gate and constants."""

    kind: str
    options: dict = field(hash=False)
    source: str | None = None
    when: dict = field(default_factory=dict, hash=False)
    constants: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Parser:
    name: str
    vendor: str
    product: str
    priority: int
    starts_with: str | None
    contains: tuple[str, ...]
    regex: str | None
    syslog: bool
    strategy: Step
    subs: tuple[Step, ...]
    timestamps: tuple[tuple[tuple[str, ...], str], ...]

    def matches(self, text: Column) -> Column:
        """The cheap tests first."""
        tests = [text.startswith(self.starts_with)] if self.starts_with else []
        tests += [text.contains(c) for c in self.contains]
        tests += [text.rlike("(?s)" + self.regex)] if self.regex else []
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def _only(table: dict, known: set[str], where: str) -> None:
    if extra := set(table) - known:
        raise Invalid(f"{where}: unknown key {sorted(extra)[0]}")


def _step(table: dict, where: str, sub: bool) -> Step:
    kind = table.get("kind")
    if kind not in KEYS:
        raise Invalid(f"{where}: unknown kind {kind}")
    _only(table, KEYS[kind] | {"kind"} | ({"field", "when", "constants"} if sub else set()), where)
    options = {k: v for k, v in table.items() if k in KEYS[kind]}
    if kind == "pattern":
        for p in options.get("patterns", []):
            try:
                compile_pattern(p, options.get("anchor", "start"))
            except (ValueError, KeyError) as e:
                raise Invalid(f"{where}: {e}") from None
        for r in options.get("regexes", []):
            compile_regex(r)
        if not options.get("patterns") and not options.get("regexes"):
            raise Invalid(f"{where}: no pattern")
    if kind == "delimiter" and not options.get("delimiter"):
        raise Invalid(f"{where}: no delimiter")
    when = {k: [str(x) for x in (v if isinstance(v, list) else [v])] for k, v in table.get("when", {}).items()}
    return Step(kind, options, table.get("field"), when, {k: str(v) for k, v in table.get("constants", {}).items()})


def parser_of(table: dict) -> Parser:
    _only(table, {"parser", "match", "envelope", "strategy", "sub", "timestamp"}, "file")
    head, match = table.get("parser", {}), table.get("match", {})
    _only(head, {"name", "vendor", "product", "priority"}, "parser")
    _only(match, {"starts_with", "contains", "regex"}, "match")
    if not head.get("name"):
        raise Invalid("parser: no name")
    if not match:
        raise Invalid("match: at least one test")
    times = []
    for t in table.get("timestamp", []):
        _only(t, {"field", "fields", "format"}, "timestamp")
        spec = t.get("format", "auto")
        if "%" in spec:
            try:
                layout(spec)
            except ValueError as e:
                raise Invalid(f"timestamp: {e}") from None
        elif spec not in ("auto", "rfc3339", "syslog", "ctime", "epoch", "epoch_ms", "epoch_us", "epoch_ns"):
            raise Invalid(f"timestamp: unknown format {spec}")
        times.append((tuple(t.get("fields") or [t["field"]]), spec))
    subs = tuple(_step(s, f"sub {i + 1}", True) for i, s in enumerate(table.get("sub", [])))
    if any(not s.source for s in subs):
        raise Invalid("sub: no field")
    contains = match.get("contains", [])
    return Parser(
        head["name"], head.get("vendor", ""), head.get("product", ""), int(head.get("priority", 0)), match.get("starts_with"),
        tuple([contains] if isinstance(contains, str) else contains), match.get("regex"), bool(table.get("envelope", {}).get("syslog", False)),
        _step(table.get("strategy", {}), "strategy", False), subs, tuple(times),
    )


def load_parsers(folder: str | Path = HERE / "parsers") -> tuple[list[Parser], list[str]]:
    """Parsers in the order in which they are tried (priority, then name), and the problems found."""
    out: dict[str, Parser] = {}
    problems = []
    for path in sorted(Path(folder).glob("*.toml")):
        try:
            p = parser_of(tomllib.loads(path.read_text()))
            if p.name in out:
                raise Invalid(f"duplicate name {p.name}")
            out[p.name] = p
        except (Invalid, tomllib.TOMLDecodeError, KeyError, ValueError) as e:
            problems.append(f"{path.name}: {e}")
    return sorted(out.values(), key=lambda p: (-p.priority, p.name)), problems


def detect(text: Column, parsers: list[Parser]) -> Column:
    """Name of the first parser whose tests hold, or null: one CASE in order."""
    if not parsers:
        return F.lit(None).cast("string")
    out = F.when(parsers[0].matches(text), parsers[0].name)
    for p in parsers[1:]:
        out = out.when(p.matches(text), p.name)
    return out


# -- mappings ---------------------------------------------------------------------


@dataclass
class Mapping:
    name: str
    version: str
    entities: dict[str, str]
    absent: set[str]
    fields: dict[str, list[str]]
    ints: set[str]
    enums: list[dict]
    classes: list[dict]
    default_class: dict

    def __post_init__(self) -> None:
        self.alias = {a: (path, rank) for path, names in self.fields.items() for rank, a in enumerate(names)}
        self.absent_low = {ascii_lower(a) for a in self.absent}
        for e in self.enums:
            e["table"] = {ascii_lower(r): (v["value"], v["id"]) for v in e["values"] for r in v.get("raw", [])}
            e["by"] = {f: {ascii_lower(r): (v["value"], v["id"]) for v in vs for r in v.get("raw", [])} for f, vs in e.get("by_field", {}).items()}


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def _check(m: Mapping) -> None:
    seen: dict[str, str] = {}
    for path, names in m.fields.items():
        if path.split(".")[0] in ("unmapped", "pipeline"):
            raise Invalid(f"reserved path {path}")
        for a in names:
            if a in seen:
                raise Invalid(f"alias {a} feeds {seen[a]} and {path}")
            seen[a] = path
    for c in [*m.classes, m.default_class]:
        if not 0 <= c.get("uid", 0) <= LARGEST_UID:
            raise Invalid(f"class uid {c['uid']}")
    for kind, path in m.entities.items():
        if kind not in ENTITY_KINDS or path not in m.fields:
            raise Invalid(f"entity {kind} has no settable path")


def load_mapping(name: str = "ocsf", folder: str | Path = HERE / "mappings") -> tuple[Mapping | None, list[str]]:
    """All files of one schema name, merged: aliases append, enum values append, class alternatives append by uid."""
    merged: Mapping | None = None
    problems = []
    for path in sorted(Path(folder).glob("*.toml")):
        try:
            t = tomllib.loads(path.read_text())
            _only(t, {"schema", "entities", "values", "fields", "types", "enum", "class", "default_class"}, "file")
            if t["schema"]["name"] != name:
                continue
            part = Mapping(name, t["schema"].get("version", ""), t.get("entities", {}), set(t.get("values", {}).get("absent", [])), t.get("fields", {}), set(t.get("types", {}).get("int", [])), t.get("enum", []), t.get("class", []), t.get("default_class", {}))
            if merged is None:
                _check(part)
                merged = part
                continue
            for p, names in part.fields.items():
                merged.fields.setdefault(p, []).extend(x for x in names if x not in merged.fields.get(p, []))
            merged.entities = {**part.entities, **merged.entities}
            merged.absent |= part.absent
            merged.ints |= part.ints
            for e in part.enums:
                old = next((x for x in merged.enums if x["field"] == e["field"]), None)
                if old is None:
                    merged.enums.append(e)
                    continue
                for v in e["values"]:
                    known = next((x for x in old["values"] if x["value"] == v["value"]), None)
                    if known is None:
                        old["values"].append(v)
                    else:
                        known.setdefault("raw", []).extend(v.get("raw", []))
            for c in part.classes:
                old = next((x for x in merged.classes if x["uid"] == c["uid"]), None)
                if old is None:
                    merged.classes.append(c)
                else:
                    old["when"].extend(c.get("when", []))
            merged.default_class = merged.default_class or part.default_class
            merged.__post_init__()
            _check(merged)
        except (Invalid, tomllib.TOMLDecodeError, KeyError, TypeError) as e:
            problems.append(f"{path.name}: {e}")
    return merged, problems
