"""Logical document paths: normalisation, identity, fallback titles, and the UTF-16 sort key.

Each rule exists for one value (driver) and as a column; tests hold the two against each other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConceptError

REDACTED = "<input>"
RESERVED = ("index.md", "log.md")
_ESCAPES = re.compile(r"^/|^\\\\|^[A-Za-z]:|(^|/)\.\.(/|$)|/\.?$|^$")


def normalize(path: str) -> str:
    """path without empty and ``.`` segments; raises ERR_FIELD for what is not a document below the root."""
    if _ESCAPES.search(path):
        raise ConceptError("ERR_FIELD", REDACTED, "path")
    kept = "/".join(s for s in path.split("/") if s not in ("", "."))
    if not is_document(kept.rpartition("/")[2]):
        raise ConceptError("ERR_FIELD", kept or REDACTED, "path")
    return kept


def is_document(name: str) -> bool:
    """Whether a file name is a concept document's: ends in lower-case ``.md`` and is not reserved."""
    return name.endswith(".md") and name not in RESERVED


def document_id(path: str) -> str:
    """The identity of a normalised path."""
    return path.removesuffix(".md")


def fallback_title(identity: str) -> str:
    """Last segment, runs of ``-`` and ``_`` as a blank, first letter (of the basic plane) capital."""
    words = re.sub("[-_]+", " ", identity.rpartition("/")[2])
    return words[:1].upper() + words[1:] if words and ord(words[0]) < 0x10000 else words


def normalized(path: Column) -> Column:
    """struct(path, document_id, error_path): error_path is set where normalize() would raise."""
    kept = F.array_join(F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")), "/")
    name = F.element_at(F.split(kept, "/"), -1)
    bad = path.rlike(_ESCAPES.pattern)
    document = name.endswith(".md") & ~name.isin(*RESERVED)
    error = F.when(bad, REDACTED).when(~document, F.when(kept == "", REDACTED).otherwise(kept))
    good = error.isNull()
    return F.struct(F.when(good, kept).alias("path"), F.when(good, F.regexp_replace(kept, r"\.md$", "")).alias("document_id"), error.alias("error_path"))


def titled(identity: Column) -> Column:
    """fallback_title() of a column."""
    words = F.regexp_replace(F.element_at(F.split(identity, "/"), -1), "[-_]+", " ")
    return F.when(F.ascii(words) < 0x10000, F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))).otherwise(words)


def utf16_order(path: Column) -> Column:
    """A key that sorts as UTF-16 code units do."""
    return F.hex(F.encode(path, "UTF-16BE"))
