"""Concept frontmatter: the envelope, the typed fields with their diagnostics, actors and timestamps."""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import message
from . import yaml_core

#: The standard keys, in the order in which they are judged.
STANDARD = ("type", "title", "description", "resource", "tags", "sources", "usage_window", "generated", "verified", "status", "stale_after", "runtime", "parameters", "computation", "executor", "attester")
STATUSES = ("draft", "stable", "deprecated")
TIERS = ("unverified", "machine-confirmed", "human-reviewed")
ATTESTED = "Attested Computation"
ENVELOPE = r"(?s)\A---\r?\n(?:(.*?)\r?\n)?---(?:\r?\n(.*)|\r?)\Z"
_ENVELOPE = re.compile(ENVELOPE)
_ACTOR = re.compile(r"(?:human|process):[^\s﻿]+|[^\s﻿/]+/[^\s﻿/]+")
ACTOR = r"^(?:(?:human|process):[^\s\x{FEFF}]+|[^\s\x{FEFF}/]+/[^\s\x{FEFF}/]+)$"
_TIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?:Z|([+-])(\d\d):(\d\d))", re.ASCII)
TIME = r"^(\d{4}-\d\d-\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?:Z|([+-])(\d\d):(\d\d))$"


def split(markdown: str) -> tuple[str, str, int] | None:
    """(yaml, body, line of the body's first line), or None without an envelope."""
    found = _ENVELOPE.match(markdown)
    if not found:
        return None
    body = found[2] or ""
    return found[1] or "", body, markdown.count("\n", 0, len(markdown) - len(body)) + 1


def epoch_millis(text) -> int | None:
    """Milliseconds since 1970 of a full timestamp; digits past the third of a second round up."""
    found = _TIME.fullmatch(text) if isinstance(text, str) else None
    if not found:
        return None
    year, month, day, hour, minute, second = map(int, found.groups()[:6])
    shift = int(found[9] or 0) * 60 + int(found[10] or 0)
    if hour > 23 or minute > 59 or second > 59 or int(found[9] or 0) > 23 or int(found[10] or 0) > 59:
        return None
    try:  # year 0 counts as 400 years, which repeat, before year 400
        days = dt.date(year or 400, month, day).toordinal() - (0 if year else 146_097) - dt.date(1970, 1, 1).toordinal()
    except ValueError:
        return None
    fraction = (found[7] or "").ljust(3, "0")
    millis = int(fraction[:3]) + bool(fraction[3:].strip("0"))
    return ((days * 24 + hour) * 60 + minute - (shift if found[8] != "-" else -shift)) * 60_000 + second * 1000 + millis


def timestamp_millis(text: Column) -> Column:
    """epoch_millis() of a column; null where it is invalid."""
    part = lambda k: F.regexp_extract(text, TIME, k)
    n = lambda k: F.coalesce(F.try_cast(part(k), "int") if hasattr(F, "try_cast") else part(k).try_cast("int"), F.lit(0))
    days = F.datediff(part(1).try_cast("date"), F.lit("1970-01-01").cast("date"))
    fraction = F.rpad(part(5), 3, "0")
    millis = F.substring(fraction, 1, 3).try_cast("int") + F.when(F.substring(part(5), 4, 1 << 30).rlike("[1-9]"), 1).otherwise(0)
    shift = (n(7) * 60 + n(8)) * F.when(part(6) == "-", -1).otherwise(1)
    fine = text.rlike(TIME) & (n(2) < 24) & (n(3) < 60) & (n(4) < 60) & (n(7) < 24) & (n(8) < 60)
    return F.when(fine, ((days.cast("long") * 24 + n(2)) * 60 + n(3) - shift) * 60_000 + n(4) * 1000 + millis)


def is_actor(text) -> bool:
    """Whether text names a person, a process or a tool."""
    return isinstance(text, str) and _ACTOR.fullmatch(text) is not None


class _Judge:
    """Reads typed members of mappings and notes each one that is wrong, in order."""

    def __init__(self, path: str):
        self.path, self.wrong = path, []

    def note(self, field: str) -> None:
        self.wrong.append({"code": "ERR_FIELD", "message": message("ERR_FIELD", self.path, field), "path": self.path, "field": field})

    def read(self, data: dict, key: str, test, base: str = "", required: bool = False):
        """(value, fine): a missing optional member is fine and None."""
        if key in data and test(data[key]):
            return data[key], True
        if key in data or required:
            self.note(f"{base}.{key}" if base else key)
            return None, False
        return None, True

    def rows(self, data: dict, key: str) -> list | None:
        if key in data and not isinstance(data[key], list):
            self.note(key)
            return None
        return data.get(key)

    def window(self, data: dict, key: str, base: str = ""):
        if key not in data:
            return None, True
        name = f"{base}.{key}" if base else key
        if not isinstance(data[key], dict):
            self.note(name)
            return None, False
        (start, a), (end, b) = (self.read(data[key], k, is_time, name, True) for k in ("from", "to"))
        return ({"from": start, "to": end}, True) if a and b else (None, False)


def is_text(v) -> bool:
    return isinstance(v, str)


def is_time(v) -> bool:
    return epoch_millis(v) is not None


def is_number(v) -> bool:
    return type(v) in (int, float)


def project(data: dict, path: str, title: str) -> tuple[dict, list[dict]]:
    """Typed fields and diagnostics of a frontmatter mapping; a missing type is noted first, under field type."""
    judge = _Judge(path)
    out: dict = {}
    out["type"], _ = judge.read(data, "type", lambda v: is_text(v) and bool(v.strip()), required=True)
    found, fine = judge.read(data, "title", is_text)
    out["title"] = title if fine and "title" not in data else found or ""
    for key in ("description", "resource"):
        out[key], _ = judge.read(data, key, is_text)
    out["tags"] = _texts(judge, data, "tags") or []
    out["sources"], out["source_text"] = _sources(judge, data)
    out["usage_window"], _ = judge.window(data, "usage_window")
    out["generated"] = _generated(judge, data)
    out["verified"], out["trust_tier"] = _verified(judge, data)
    found, fine = judge.read(data, "status", lambda v: is_text(v) and v in STATUSES)
    out["status"] = (found or "stable") if fine else None
    out["stale_after"], out["staleness_classified"] = judge.read(data, "stale_after", is_time)
    out["stale_after_epoch"] = epoch_millis(out["stale_after"])
    out["runtime"], _ = judge.read(data, "runtime", is_text, required=out["type"] == ATTESTED)
    out["parameters"] = _parameters(judge, data)
    out["computation"], _ = judge.read(data, "computation", is_text)
    out["executor"], out["attester"] = _executor(judge, data), _attester(judge, data)
    out["extensions"] = json.dumps({k: v for k, v in data.items() if k not in STANDARD}, ensure_ascii=False)
    return out, judge.wrong


def _texts(judge: _Judge, data: dict, key: str, base: str = "") -> list[str] | None:
    values = judge.rows(data, key) if not base else data.get(key)
    name = f"{base}.{key}" if base else key
    for i, v in enumerate(values or []):
        if not is_text(v):
            judge.note(f"{name}[{i}]")
    return None if values is None else [v for v in values if is_text(v)]


def _sources(judge: _Judge, data: dict) -> tuple[list[dict], str]:
    rows, words = [], []
    for i, row in enumerate(judge.rows(data, "sources") or []):
        base = f"sources[{i}]"
        if not isinstance(row, dict):
            judge.note(base)
            continue
        shape = (("resource", is_text), ("id", is_text), ("title", is_text), ("author", is_actor), ("usage_count", is_number), ("last_modified", is_time))
        read = {k: judge.read(row, k, test, base, k == "resource") for k, test in shape}
        window, fine = judge.window(row, "usage_window", base)
        words += [read[k][0] for k in ("id", "title", "author", "resource") if read[k][0]]
        if fine and all(ok for _, ok in read.values()):
            kept = {k: v for k, (v, _) in read.items()}
            rows.append(kept | {"usage_count": None if kept["usage_count"] is None else float(kept["usage_count"]), "usage_window": window})
    return rows, " ".join(words)


def _generated(judge: _Judge, data: dict) -> dict | None:
    if not isinstance(data.get("generated", {}), dict):
        judge.note("generated")
    elif "generated" in data:
        (by, a), (at, b) = judge.read(data["generated"], "by", is_actor, "generated", True), judge.read(data["generated"], "at", is_time, "generated")
        return {"by": by, "at": at} if a and b else None
    return None


def _verified(judge: _Judge, data: dict) -> tuple[list[dict], str | None]:
    given = data.get("verified", [])
    events = given if isinstance(given, list) else [given]
    if not isinstance(given, (list, dict)):
        judge.note("verified")
        return [], None
    kept = []
    for i, event in enumerate(events):
        if not isinstance(event, dict):
            judge.note(f"verified[{i}]")
            continue
        (by, a), (at, b) = judge.read(event, "by", is_actor, f"verified[{i}]", True), judge.read(event, "at", is_time, f"verified[{i}]", True)
        if a and b:
            kept.append({"by": by, "at": at})
    if any(e["by"].startswith("human:") for e in kept):
        return kept, "human-reviewed"
    return kept, "machine-confirmed" if kept else None if events else "unverified"


def _parameters(judge: _Judge, data: dict) -> list[dict] | None:
    rows = judge.rows(data, "parameters")
    kept = []
    for i, row in enumerate(rows or []):
        base = f"parameters[{i}]"
        if not isinstance(row, dict):
            judge.note(base)
            continue
        read = {k: judge.read(row, k, test, base, True) for k, test in (("name", is_text), ("type", is_text), ("required", lambda v: isinstance(v, bool)))}
        if all(ok for _, ok in read.values()):
            kept.append({k: v for k, (v, _) in read.items()})
    return None if rows is None else kept


def _executor(judge: _Judge, data: dict) -> dict | None:
    if "executor" not in data:
        return None
    given = data["executor"]
    if not isinstance(given, dict):
        judge.note("executor")
        return None
    resource, a = judge.read(given, "resource", is_text, "executor", True)
    receipt, b = judge.read(given, "receipt", lambda v: isinstance(v, list), "executor", True)
    texts = _texts(judge, given, "receipt", "executor") if b else None
    return {"resource": resource, "receipt": texts} if a and b and len(texts) == len(receipt) else None


def _attester(judge: _Judge, data: dict) -> dict | None:
    if "attester" not in data:
        return None
    if not isinstance(data["attester"], dict):
        judge.note("attester")
        return None
    resource, fine = judge.read(data["attester"], "resource", is_text, "attester", True)
    return {"resource": resource} if fine else None


def parse(markdown: str, path: str, title: str) -> tuple[dict | None, list[dict], str, int]:
    """(fields, diagnostics, body, body line); fields is None when the document is fatal."""
    parts = split(markdown)
    try:
        data = yaml_core.load(parts[0]) if parts else None
    except yaml_core.YamlError:
        data = None
    if not isinstance(data, dict):
        return None, [{"code": "ERR_PARSE", "message": message("ERR_PARSE", path), "path": path, "field": None}], "", 0
    fields, wrong = project(data, path, title)
    return (fields if fields["type"] is not None else None), wrong, parts[1], parts[2]
