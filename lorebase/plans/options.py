"""Search options: defaults, validation with exact messages in a fixed order, and the filters as columns."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The search fields and their default boosts, in the order in which fields are reported by default.
BOOSTS = {"title": 5.0, "type": 1.5, "tags": 2.0, "resource": 6.0, "heading": 4.0, "description": 3.0, "sources": 1.0, "body": 1.0}
FIELDS = tuple(BOOSTS)
FILTERS = ("types", "tagsAny", "statuses", "trustTiers", "stale", "conformance")
VALUES = {"statuses": ("draft", "stable", "deprecated"), "trustTiers": ("unverified", "machine-confirmed", "human-reviewed"), "conformance": ("strict", "degraded")}
NAMES = {"statuses": "Status", "trustTiers": "TrustTier", "conformance": "Conformance"}
TOKEN = r"[\p{IsAlphabetic}\p{N}]+"
_TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}]+")
MAX_TERM = 65_530
FUZZY = 0.2


def tokens(text: str) -> list[str]:
    """Analysed terms: alphanumeric runs, each lower-cased, over-long ones dropped."""
    return [t for t in (t.lower() for t in _TOKEN.findall(text)) if len(t.encode()) <= MAX_TERM]


def tokenized(text: Column) -> Column:
    """tokens() of a column, as an array."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: F.lower(t))
    return F.filter(found, lambda t: F.octet_length(t) <= MAX_TERM)


def among(column: str, values: list[str]) -> Column:
    """Whether a string column is one of many values, as literals in one expression; hexadecimal, so any text is safe."""
    return F.expr(listed(column, values))


def listed(column: str, values: list[str]) -> str:
    """among() as SQL."""
    return f"{column} IN (" + ", ".join(map(quoted, values)) + ")" if values else "false"


def quoted(value: str) -> str:
    """A string literal of any text as SQL."""
    return f"CAST(X'{value.encode().hex()}' AS STRING)"


@dataclass(frozen=True)
class Options:
    """Validated search options; None stands for a default."""

    limit: int = 10
    snippet_length: int = 240
    where: dict = field(default_factory=dict)
    as_of: int = 0
    match: str = "any"
    fields: tuple[str, ...] = FIELDS
    boost: dict = field(default_factory=lambda: dict(BOOSTS))
    fuzzy: float = 0.0
    #: Only suggestions differ here: shortest final term that is a prefix, plain (not fuzzy) prefixes, single edits.
    prefix_from: int = 3
    fuzzy_prefix: bool = True
    max_edits: int = 2


# The texts of the errors below, which callers compare.


def _fail(text: str):
    raise TypeError(text)


def _number(v) -> bool:
    return type(v) in (int, float) and math.isfinite(v)


def _as_of(v) -> int:
    if v is None:
        return int(dt.datetime.now(dt.UTC).timestamp() * 1000)
    if isinstance(v, dt.datetime):
        return int((v if v.tzinfo else v.replace(tzinfo=dt.UTC)).timestamp() * 1000)
    return v if type(v) is int else _fail("options.asOf must be a valid Date")


def _fields(v) -> tuple[str, ...]:
    if not isinstance(v, (list, tuple)) or not v:
        _fail("options.fields must be a non-empty array")
    if not all(isinstance(x, str) and x in FIELDS for x in v):
        _fail("options.fields must contain only valid SearchField values")
    return tuple(dict.fromkeys(v))


def _fuzzy(v) -> float:
    if isinstance(v, bool):
        return FUZZY if v else 0.0
    return float(v) if _number(v) and 0 <= v <= 1 else _fail("options.fuzzy must be a boolean or a finite number between 0 and 1, inclusive")


def _where(v) -> dict:
    if not isinstance(v, dict):
        _fail("options.where must be an object")
    if not set(v) <= set(FILTERS):
        _fail("options.where must contain only valid filter names")
    out = {}
    for name in FILTERS:
        given = v.get(name)
        if given is None:
            continue
        if name == "stale":
            out[name] = given if isinstance(given, bool) else _fail("options.where.stale must be a boolean")
            continue
        if not isinstance(given, (list, tuple)):
            _fail(f"options.where.{name} must be an array")
        allowed = VALUES.get(name)
        if not all(isinstance(x, str) and (allowed is None or x in allowed) for x in given):
            _fail(f"options.where.{name} must contain only " + (f"valid {NAMES[name]} values" if allowed else "strings"))
        if given:
            out[name] = sorted(set(given))
    return out


def _boost(v, base: dict) -> dict:
    if not isinstance(v, dict):
        _fail("options.boost must be an object")
    if not set(v) <= set(FIELDS):
        _fail("options.boost must contain only valid SearchField keys")
    for name in FIELDS:
        if v.get(name) is not None and not (_number(v[name]) and 0.1 <= v[name] <= 10):
            _fail(f"options.boost.{name} must be a finite number between 0.1 and 10, inclusive")
    return base | {k: float(x) for k, x in v.items() if x is not None}


def validate(query, options: dict | None = None, suggest: bool = False) -> Options:
    """Options of a search or suggestion; raises TypeError with the first thing that is wrong, in a fixed order."""
    if not isinstance(query, str):
        _fail("query must be a string")
    given = dict(options or {})
    if unknown := set(given) - {"asOf", "limit", "snippetLength", "match", "fields", "fuzzy", "where", "boost"}:
        _fail(f"options must not contain {sorted(unknown)[0]}")
    if suggest and "asOf" in given and given["asOf"] is None:
        _fail("options.asOf must be a valid Date")
    flat = {name: 1.0 for name in FIELDS}
    out: dict = {"as_of": _as_of(given.get("asOf"))}
    limit = given.get("limit", 10)
    out["limit"] = limit if type(limit) is int and limit >= 0 else _fail("options.limit must be a finite non-negative integer")
    length = given.get("snippetLength", 240)
    out["snippet_length"] = length if type(length) is int and 0 < length < 1 << 53 else _fail("options.snippetLength must be a positive safe integer")
    match = given.get("match", "all" if suggest else "any")
    out["match"] = match if match in ("any", "all") else _fail('options.match must be "any" or "all"')
    out["fields"] = _fields(given["fields"]) if "fields" in given else FIELDS
    out["fuzzy"] = _fuzzy(given.get("fuzzy", False))
    out["where"] = _where(given.get("where", {}))
    out["boost"] = _boost(given.get("boost", {}), flat if suggest else dict(BOOSTS))
    return Options(**out, **({"prefix_from": 1, "fuzzy_prefix": False, "max_edits": 1} if suggest else {}))


def edits(term: str, options: Options) -> int:
    """Edits that a query term may be away: its length times the ratio, half up, 1 at least."""
    return min(options.max_edits, max(1, math.floor(len(term) * options.fuzzy + 0.5))) if options.fuzzy > 0 else 0


def condition(options: Options) -> Column | None:
    """The metadata filter over documents' columns; None if it holds for all."""
    parts: list[Column] = []
    for name, column in (("types", "type"), ("statuses", "status"), ("trustTiers", "trust_tier"), ("conformance", "conformance")):
        if name in options.where:
            parts.append(F.col(column).isin(options.where[name]))
    if "tagsAny" in options.where:
        parts.append(F.arrays_overlap("tags", F.array(*map(F.lit, options.where["tagsAny"]))))
    if "stale" in options.where:
        due = F.coalesce(F.col("stale_after_epoch") <= options.as_of, F.lit(False))
        parts.append(F.col("staleness_classified") & (due if options.where["stale"] else ~due))
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out
