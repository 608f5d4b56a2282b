"""The one error type of the library and its message templates."""

from __future__ import annotations

#: Message by code.
MESSAGES = {
    "ERR_READ": "Cannot read concept path: {}",
    "ERR_PARSE": "Cannot parse concept: {}",
    "ERR_FIELD": "Invalid concept field: {}",
    "ERR_CACHE_INVALID": "Invalid concept cache: {}",
    "ERR_CACHE_INCOMPATIBLE": "Incompatible concept cache: {}",
    "ERR_WRITE": "Cannot write concept cache: {}",
    "ERR_CACHE_BUSY": "Concept cache is busy: {}",
    "ERR_INDEX_UNUSABLE": "Search index failed while mutating {}; this handle is permanently unusable and must be rebuilt",
    "ERR_UNSUPPORTED": "Unsupported concept operation: {}",
}


def message(code: str, path: str, field: str | None = None) -> str:
    """The text of an error or diagnostic."""
    if code == "ERR_INDEX_UNUSABLE" and path == "<index>":
        return "Search index is permanently unusable and must be rebuilt"
    return MESSAGES[code].format(f"{path} ({field})" if field else path)


class ConceptError(Exception):
    """A failure with a code, the path it concerns and, for field errors, the field."""

    def __init__(self, code: str, path: str, field: str | None = None):
        super().__init__(message(code, path, field))
        self.code, self.path, self.field = code, path, field
