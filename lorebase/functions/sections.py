"""Sections and chunks of a concept's body, with ids, heading paths and line ranges."""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .markdown import BREAKS, Block, blocks

#: A section of at most WHOLE words is one chunk; longer ones are cut near TARGET, with no tail below TAIL.
WHOLE, TARGET, TAIL = 800, 500, 250
UNTITLED = "Untitled section"
_WORD = regex.compile(r"[\p{L}\p{N}_]+")
#: Fixed value: what str.strip() removes.
_BLANKS = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def word_count(text: str) -> int:
    """Runs of letters, numbers and underscores."""
    return len(_WORD.findall(text))


def counted_words(text: Column) -> Column:
    """word_count() of a column."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).cast("long")


def slug(text: str) -> str:
    """A URL-like name of a heading path; ``section`` if nothing is left."""
    return _OTHER.sub("-", unicodedata.normalize("NFKD", text).lower()).strip("-") or "section"


def clean(text: str) -> str:
    """Trimmed, with line feeds only."""
    return BREAKS.sub("\n", text.strip())


def cleaned(text: Column) -> Column:
    """clean() of a column."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{_BLANKS}]++|[{_BLANKS}]++\\z", ""), "\r\n?", "\n")


@dataclass
class Draft:
    """A section before it is cut: its heading path, heading line and content blocks."""

    path: list[str]
    line: int | None
    parts: list[Block] = field(default_factory=list)


def drafts(found: list[Block], title: str) -> list[Draft]:
    """Sections by heading; what stands before the first heading, or nothing at all, is the root's."""
    out, stack = [Draft([title], None)], []
    for b in found:
        if not b.depth:
            out[-1].parts.append(b)
            continue
        while stack and stack[-1][0] >= b.depth:
            stack.pop()
        stack.append((b.depth, b.text.strip() or UNTITLED))
        out.append(Draft([name for _, name in stack], b.first))
    return out if len(out) == 1 or out[0].parts else out[1:]


def groups(sizes: list[int]) -> list[range]:
    """Ranges of blocks that make chunks, by their words."""
    if sum(sizes) <= WHOLE:
        return [range(len(sizes))]
    cuts, held = [0], 0
    for i, n in enumerate(sizes):
        if i > cuts[-1] and held + n > TARGET:
            cuts.append(i)
            held = 0
        held += n
    if len(cuts) > 1 and held < TAIL:
        cuts.pop()
    return [range(a, b) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True)]


def sections(document_id: str, title: str, body: str, first_line: int = 1) -> list[dict]:
    """Every chunk of a body: section_id, heading_path, text, start_line, end_line."""
    ends = [m.end() for m in BREAKS.finditer(body)]
    starts = [0, *ends]
    between = lambda a, b: body[starts[a - 1] : ends[b - 1] if b <= len(ends) else len(body)]
    used: Counter[str] = Counter()
    out = []
    for draft in drafts(blocks(body), title):
        name = "root" if draft.line is None else slug("-".join(draft.path))
        used[name] += 1
        name += f"--{used[name]}" if used[name] > 1 else ""
        cut = groups([word_count(between(b.first, b.last)) for b in draft.parts])
        for k, group in enumerate(cut):
            own = [draft.parts[i] for i in group]
            at = draft.line or (own[0].first if own else 1)
            out.append({
                "section_id": f"{document_id}#{name}" + (f"--part-{k + 1}" if len(cut) > 1 else ""),
                "heading_path": " > ".join(draft.path),
                "text": clean(between(own[0].first, own[-1].last)) if own else "",
                "start_line": first_line - 1 + (own[0].first if own and k else at),
                "end_line": first_line - 1 + (own[-1].last if own else at),
            })
    return out
