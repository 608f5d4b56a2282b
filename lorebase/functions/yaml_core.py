"""YAML 1.2 core values from parser events, under resource limits that hold before anything is expanded."""

from __future__ import annotations

import re

import yaml

MAX_BYTES = 1 << 20
MAX_DEPTH = 64
MAX_NODES = 100_000
MAX_LOADED = 8 << 20
_CORE = "tag:yaml.org,2002:"
#: Plain scalars that are not strings.
_RULES = [
    (re.compile(r"null|Null|NULL|~|"), lambda s: None),
    (re.compile(r"true|True|TRUE|false|False|FALSE"), lambda s: s[0] in "tT"),
    (re.compile(r"[-+]?[0-9]+"), int),
    (re.compile(r"0o[0-7]+"), lambda s: int(s[2:], 8)),
    (re.compile(r"0x[0-9a-fA-F]+"), lambda s: int(s[2:], 16)),
    (re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?"), float),
    (re.compile(r"[-+]?\.(inf|Inf|INF)"), lambda s: float("-inf") if s[0] == "-" else float("inf")),
    (re.compile(r"\.(nan|NaN|NAN)"), lambda s: float("nan")),
]
_KINDS = {"null": lambda v: v is None, "bool": lambda v: isinstance(v, bool), "int": lambda v: type(v) is int, "float": lambda v: type(v) in (int, float)}


class YamlError(ValueError):
    """The text is not one acceptable YAML document."""


def _plain(text: str):
    for rule, make in _RULES:
        if rule.fullmatch(text):
            value = make(text)
            return float(value) if type(value) is int and not -(1 << 63) <= value < 1 << 63 else value
    return text


def _scalar(event):
    tag = event.tag
    if tag in (None, "!") or not tag.startswith(_CORE):
        return _plain(event.value) if event.implicit[0] or (tag not in (None, "!") and event.style in (None, "")) else event.value
    kind = tag.removeprefix(_CORE)
    if kind == "str":
        return event.value
    value = _plain(event.value)
    if kind not in _KINDS or not _KINDS[kind](value):
        raise YamlError(f"unsupported tag {tag}")
    return float(value) if kind == "float" else value


class _Node:
    """A collection under construction, with what it costs to copy."""

    def __init__(self, anchor, size, keyed):
        self.anchor, self.size, self.nodes, self.depth = anchor, size, 1, 1
        self.value = {} if keyed else []
        self.key = None
        self.waits = keyed  # for a key


def load(text: str):
    """The value of the one document in text; raises YamlError."""
    try:
        if len(text.encode()) > MAX_BYTES:
            raise YamlError("too many bytes")
        return _build(text)
    except YamlError:
        raise
    except (yaml.YAMLError, UnicodeError, ValueError, RecursionError) as e:
        raise YamlError(str(e)) from e


def _build(text: str):
    open_: list[_Node] = []
    anchors: dict[str, tuple] = {}
    spent = [0, 0]
    root, documents = None, 0

    def charge(nodes, size):
        spent[0] += nodes
        spent[1] += size
        if spent[0] > MAX_NODES or spent[1] > MAX_LOADED:
            raise YamlError("expansion limit")

    def place(value, nodes, size, depth):
        nonlocal root
        if not open_:
            root = value
            return
        parent = open_[-1]
        parent.nodes, parent.size, parent.depth = parent.nodes + nodes, parent.size + size, max(parent.depth, depth + 1)
        if isinstance(parent.value, list):
            parent.value.append(value)
        elif parent.waits:
            if not isinstance(value, str):
                raise YamlError("a key must be a string")
            if value in parent.value:
                raise YamlError("duplicate key")
            parent.key, parent.waits = value, False
        else:
            parent.value[parent.key], parent.waits = value, True

    for event in yaml.parse(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        if isinstance(event, yaml.DocumentStartEvent):
            documents += 1
            anchors.clear()
            if documents > 1:
                raise YamlError("more than one document")
        elif isinstance(event, yaml.CollectionStartEvent):
            tag = event.tag or ""
            keyed = isinstance(event, yaml.MappingStartEvent)
            if tag.startswith(_CORE) and tag != _CORE + ("map" if keyed else "seq"):
                raise YamlError(f"unsupported tag {tag}")
            if len(open_) + 1 > MAX_DEPTH:
                raise YamlError("nesting limit")
            charge(1, len(tag.encode()))
            open_.append(_Node(event.anchor, len(tag.encode()), keyed))
            if event.anchor:
                anchors.pop(event.anchor, None)
        elif isinstance(event, yaml.CollectionEndEvent):
            node = open_.pop()
            if node.anchor:  # an anchored value is kept as a copy
                charge(node.nodes, node.size)
                anchors[node.anchor] = (node.value, node.nodes, node.size, node.depth)
            place(node.value, node.nodes, node.size, node.depth)
        elif isinstance(event, (yaml.ScalarEvent, yaml.AliasEvent)):
            if isinstance(event, yaml.AliasEvent):
                if event.anchor not in anchors:
                    raise YamlError("recursive or unknown alias")
                value, nodes, size, depth = anchors[event.anchor]
            else:
                nodes, depth, size = 1, 1, len(event.value.encode()) + len((event.tag or "").encode())
                value = _scalar(event)
            if len(open_) + depth > MAX_DEPTH:
                raise YamlError("nesting limit")
            charge(nodes, size)
            if isinstance(event, yaml.ScalarEvent) and event.anchor:
                charge(nodes, size)
                anchors[event.anchor] = (value, nodes, size, depth)
            place(value, nodes, size, depth)
    if documents != 1:
        raise YamlError("no document")
    return root
