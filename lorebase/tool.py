"""A search tool for agents: its own defaults, absolute paths, and hits as text."""

from __future__ import annotations

import os

from .handle import ConceptSearch

LIMITS = (1, 10)
DEFAULT_LIMIT = 5


def tool_search(handle: ConceptSearch, root: str, query: str, limit: int = DEFAULT_LIMIT, match: str = "any", fuzzy: bool | float = True, fields: list[str] | None = None, where: dict | None = None) -> list[dict]:
    """Hits as dictionaries, with absolute_path; fuzzy by default, at most ten."""
    if not isinstance(query, str) or not query.strip():
        raise TypeError("query must be a non-blank string")
    if type(limit) is not int or not LIMITS[0] <= limit <= LIMITS[1]:
        raise TypeError(f"limit must be an integer from {LIMITS[0]} to {LIMITS[1]}")
    options = {"limit": limit, "match": match, "fuzzy": fuzzy} | ({"fields": fields} if fields is not None else {}) | ({"where": where} if where is not None else {})
    rows = handle.search(query, options).collect()
    return [r.asDict() | {"absolute_path": os.path.normpath(os.path.join(root, r.path))} for r in rows]


def render(hits: list[dict]) -> str:
    """Hits as numbered blocks of text."""
    if not hits:
        return "No matches."
    blocks = [f"{len(hits)} hit" + "s" * (len(hits) != 1)]
    for k, hit in enumerate(hits, 1):
        heading = hit["heading_path"].removeprefix(f"{hit['title']} > ")
        lines = [f"{k}. {hit['title']}"]
        if heading and heading != hit["title"]:
            lines.append(f"Heading: {heading}")
        lines += [f"{hit['absolute_path']}:{hit['start_line']}-{hit['end_line']}", f"Matched: {', '.join(hit['matched_fields'])}", hit["snippet"]]
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks)


def filters(types: str = "", tags: str = "", statuses: str = "", trust_tiers: str = "", conformance: str = "", stale: bool | None = None) -> dict:
    """A where object of comma-separated texts; blanks and repeats are dropped."""
    given = {"types": types, "tagsAny": tags, "statuses": statuses, "trustTiers": trust_tiers, "conformance": conformance}
    out: dict = {k: list(dict.fromkeys(x.strip() for x in v.split(",") if x.strip())) for k, v in given.items()}
    return {k: v for k, v in out.items() if v} | ({} if stale is None else {"stale": stale})
