"""The blocks directly below a Markdown document's root, with their lines, and headings' plain text.

CommonMark without extensions. Containers (quotes, lists) are one block each: what is inside matters only for where
they end, which a lazily continued paragraph decides.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple


class Block(NamedTuple):
    """Lines are numbered from 1; depth and text are set for headings."""

    first: int
    last: int
    depth: int = 0
    text: str = ""


BREAKS = re.compile(r"\r\n|\r|\n")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)([ \t]*)(.*)$")
#: Element names that begin an HTML block of the sixth kind.
_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_ATTRIBUTE = r"""(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
_TAG = rf"(?:<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)"
#: (begin, end) of each kind of HTML block; None ends at a blank line.
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(_NAMES.split())})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf" {{0,3}}{_TAG}\s*$"), None),
]
_DEFINITION = re.compile(r""" {0,3}\[((?:[^\[\]\\]|\\.)*\S(?:[^\[\]\\]|\\.)*)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]*\n[ \t]*|[ \t]+)("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)""")


def _indent(line: str) -> int:
    width = 0
    for c in line:
        if c == " ":
            width += 1
        elif c == "\t":
            width += 4 - width % 4
        else:
            break
    return width


def _outdent(line: str, by: int) -> str:
    """line without `by` columns of leading blanks; tabs count to the next multiple of four."""
    width = 0
    for i, c in enumerate(line):
        if width >= by or c not in " \t":
            return " " * max(0, width - by) + line[i:]
        width += 1 if c == " " else 4 - width % 4
    return " " * max(0, width - by)


def _html(line: str, in_paragraph: bool = False) -> int | None:
    return next((k for k, (begin, _) in enumerate(_HTML) if begin.match(line) and not (in_paragraph and k == 6)), None)


def _interrupts(line: str) -> bool:
    """Whether line begins a block where a paragraph is open."""
    if _indent(line) >= 4:
        return False
    item = _ITEM.match(line)
    starts_list = item and item[4] and (item[2] in "-+*" or item[2][:-1].lstrip("0") == "1" or item[2][:-1] == "1")
    return bool(_RULE.match(line) or _ATX.match(line) or _FENCE.match(line) or _QUOTE.match(line) or starts_list or _html(line, True) is not None)


def _ends_in_paragraph(lines: list[str]) -> bool:
    """Whether a paragraph is open at the end of a container's lines, at any depth."""
    if not lines or not lines[-1].strip():
        return False
    scanner = _Scanner(lines)
    scanner.run()
    return scanner.open


class _Scanner:
    """One pass over lines; `names` collects the labels of link definitions."""

    def __init__(self, lines: list[str]):
        self.lines, self.names = lines, set()
        self.open = False  # whether the last block is a paragraph or ends in one

    def run(self) -> list[Block]:
        out, i, n = [], 0, len(self.lines)
        while i < n:
            line = self.lines[i]
            if not line.strip():
                i, self.open = i + 1, False
                continue
            self.open = False
            block, i = self._block(i)
            if block:
                out.append(block)
        return out

    def _block(self, i: int) -> tuple[Block | None, int]:
        lines, n, line = self.lines, len(self.lines), self.lines[i]
        if _indent(line) >= 4:
            last = j = i
            while j < n and (not lines[j].strip() or _indent(lines[j]) >= 4):
                last = j if lines[j].strip() else last
                j += 1
            return Block(i + 1, last + 1), last + 1
        if _RULE.match(line):
            return Block(i + 1, i + 1), i + 1
        if atx := _ATX.match(line):
            return Block(i + 1, i + 1, len(atx[1]), (atx[2] or "").strip()), i + 1
        if fence := _FENCE.match(line):
            mark = fence[1]
            for j in range(i + 1, n):
                bare = lines[j].strip(" \t")
                if _indent(lines[j]) < 4 and len(bare) >= len(mark) and set(bare) == {mark[0]}:
                    return Block(i + 1, j + 1), j + 1
            return Block(i + 1, n), n
        kind = _html(line)
        if kind is not None:
            end = _HTML[kind][1]
            j = i
            while j < n and not (end.search(lines[j]) if end else not lines[j].strip()):
                j += 1
            last = min(j, n - 1) if end else j - 1
            return Block(i + 1, last + 1), last + 1
        if _QUOTE.match(line):
            return self._container(i, self._quote)
        if _ITEM.match(line):
            return self._list(i)
        return self._paragraph(i)

    def _quote(self, line: str) -> str | None:
        found = _QUOTE.match(line)
        return line[found.end() :] if found else None

    def _container(self, i: int, inner) -> tuple[Block, int]:
        held, j = [], i
        while j < len(self.lines):
            line = self.lines[j]
            own = inner(line)
            if own is None and not (line.strip() and not _interrupts(line) and _ends_in_paragraph(held)):
                break
            held.append(line.strip() if own is None else own)
            j += 1
        self.open = _ends_in_paragraph(held)
        return Block(i + 1, j), j

    def _list(self, i: int) -> tuple[Block, int]:
        first = _ITEM.match(self.lines[i])
        kind = first[2][-1]
        last, j, held, content = i, i, [], 0
        while j < len(self.lines):
            line = self.lines[j]
            item = None if _indent(line) >= 4 or (held and _indent(line) >= content) or _RULE.match(line) else _ITEM.match(line)
            if not line.strip():
                if held == [""] and j > i:  # an item that begins with a blank line holds one at most
                    content = 1 << 30
                held.append("")
            elif item and item[2][-1] == kind:
                gap = _indent(item[3]) if item[4] else 1
                content = len(item[1]) + len(item[2]) + (gap if 1 <= gap <= 4 else 1)
                held, last = [_outdent(line[len(item[1]) + len(item[2]) :], content - len(item[1]) - len(item[2])) if item[4] else ""], j
            elif held and _indent(line) >= content:
                held.append(_outdent(line, content))
                last = j
            elif not _interrupts(line) and _ends_in_paragraph(held):
                held.append(line.strip())
                last = j
            else:
                break
            j += 1
        self.open = last == j - 1 and _ends_in_paragraph(held)
        return Block(i + 1, last + 1), last + 1

    def _paragraph(self, i: int) -> tuple[Block | None, int]:
        held, j, depth = [self.lines[i].strip()], i + 1, 0
        while j < len(self.lines) and self.lines[j].strip():
            line = self.lines[j]
            under = _SETEXT.match(line) if _indent(line) < 4 else None
            if under and self._without_definitions(held):
                depth = 1 if under[1][0] == "=" else 2
                j += 1
                break
            if _interrupts(line):
                break
            held.append(line.strip())
            j += 1
        rest = self._without_definitions(held)
        self.open = not depth and bool(rest)
        if not rest:
            return None, j
        skipped = len(held) - len(rest)
        return Block(i + 1 + skipped, j, depth, "\n".join(rest) if depth else ""), j

    def _without_definitions(self, held: list[str]) -> list[str]:
        text = "\n".join(held)
        while text.startswith("[") and (found := _DEFINITION.match(text)):
            self.names.add(_label(found[1]))
            text = text[found.end() :]
        return text.split("\n") if text.strip() else []


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def blocks(body: str) -> list[Block]:
    """The root's blocks in order, headings with their plain text."""
    lines = BREAKS.split(body)
    if lines and not lines[-1]:
        lines.pop()
    scanner = _Scanner(lines)
    found = scanner.run()
    return [b._replace(text=plain(b.text, scanner.names)) if b.depth else b for b in found]


_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]|[^\w\s]")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]*);")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>")
_RAW = re.compile(rf"{_TAG}|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_TARGET = re.compile(r"""\(\s*(?:<(?:[^<>\n\\]|\\.)*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""")
_REFERENCE = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")


def _pieces(text: str, names: set[str]):
    """Inline content as [literal, False] and delimiter runs [characters, True, opens, closes]."""
    out: list[list] = []
    brackets: list[int] = []
    i = 0
    while i < len(text):
        c = text[i]
        if found := _ESCAPED.match(text, i):
            out.append([found[1], False])
        elif c == "`" and (run := re.compile("`+").match(text, i)):
            close = re.search(rf"(?<!`){run[0]}(?!`)", text[run.end() :])
            if close:
                code = text[run.end() : run.end() + close.start()].replace("\n", " ")
                out.append([code[1:-1] if code.strip(" ") and code[0] == code[-1] == " " else code, False])
                i = run.end() + close.end()
                continue
            out.append([run[0], False])
            i = run.end()
            continue
        elif c == "<" and (found := _AUTOLINK.match(text, i)):
            out.append([found[1], False])
        elif c == "<" and (found := _RAW.match(text, i)):
            pass
        elif c == "&" and (found := _ENTITY.match(text, i)) and html.unescape(found[0]) != found[0]:
            out.append([html.unescape(found[0]), False])
        elif c in "*_":
            found = re.compile(re.escape(c) + "+").match(text, i)
            before, after = text[i - 1 : i] or " ", text[found.end() : found.end() + 1] or " "
            spaced, marked = (lambda x: x.isspace()), (lambda x: bool(_PUNCTUATION.match(x)))
            left = not spaced(after) and (not marked(after) or spaced(before) or marked(before))
            right = not spaced(before) and (not marked(before) or spaced(after) or marked(after))
            if c == "_":
                left, right = left and (not right or marked(before)), right and (not left or marked(after))
            out.append([found[0], True, left, right])
        elif c == "[" or text.startswith("![", i):
            brackets.append(len(out))
            out.append(["![" if c == "!" else "[", False])
            i += len(out[-1][0])
            continue
        elif c == "]" and brackets:
            at = brackets.pop()
            inside = "".join(p[0] for p in out[at + 1 :])
            found = _TARGET.match(text, i + 1)
            if not found:
                reference = _REFERENCE.match(text, i + 1)
                if _label(reference[1] if reference and reference[1] else inside) in names:
                    found = reference or re.compile("").match(text, i + 1)
            if found:
                out[at][0] = ""
                out[at + 1 :] = [[_emphasis(out[at + 1 :]), False]]
                i = found.end()
                continue
            out.append(["]", False])
            i += 1
            continue
        else:
            out.append([" " if c == "\n" else c, False])
            i += 1
            continue
        i = found.end()
    return out


def _emphasis(pieces: list[list]) -> str:
    """The text of pieces without the delimiters that pair up."""
    opened: list[int] = []
    for k, p in enumerate(pieces):
        if not p[1]:
            continue
        size = len(p[0])
        while p[3] and p[0]:
            match = next((j for j in reversed(opened) if pieces[j][0][:1] == p[0][0] and not ((pieces[j][3] or p[2]) and (pieces[j][4] + size) % 3 == 0 and (pieces[j][4] % 3 or size % 3))), None)
            if match is None:
                break
            del opened[opened.index(match) + 1 :]
            used = 2 if len(p[0]) > 1 and len(pieces[match][0]) > 1 else 1
            p[0], pieces[match][0] = p[0][used:], pieces[match][0][used:]
            if not pieces[match][0]:
                opened.remove(match)
        p.append(size)
        if p[0] and p[2]:
            opened.append(k)
    return "".join(p[0] for p in pieces)


def plain(text: str, names: set[str] = frozenset()) -> str:
    """The plain text of inline Markdown; names: labels of link definitions."""
    return _emphasis(_pieces(text, names))
