"""Identifiers, delimiters and progress messages."""

from __future__ import annotations

import logging
import time
import warnings

log = logging.getLogger("tallyloom")

#: Characters that no catalog name may hold (fixed value).
REJECTED = set(";'(){}?\"*")


def has_special_characters(text: str) -> bool:
    return any(c in REJECTED for c in text)


def _marks(delimiter: str) -> tuple[str, str]:
    if not 1 <= len(delimiter) <= 2:
        raise ValueError("a delimiter is one or two characters")
    return delimiter[0], delimiter[-1]


def is_delimited(text: str, delimiter: str) -> bool:
    """Whether text begins and ends with the delimiter, one character for both ends or two, as '[]'."""
    a, b = _marks(delimiter)
    return len(text) >= 2 and text[0] == a and text[-1] == b


def remove_delimiters(text: str, delimiter: str) -> str:
    """Either end is removed if it is there, whether or not the other is."""
    a, b = _marks(delimiter)
    text = text.removeprefix(a)
    return text.removesuffix(b)


def add_delimiters(text: str, delimiter: str) -> str:
    a, b = _marks(delimiter)
    return f"{a}{remove_delimiters(text, delimiter)}{b}"


def has_internal_delimiters(text: str, delimiter: str) -> bool:
    """Whether text, taken out of its delimiters, still holds one; quoted text may hold no single quote either."""
    inner = remove_delimiters(text, delimiter)
    found = set(_marks(delimiter)) | ({"'"} if delimiter == '"' else set())
    return any(c in inner for c in found)


def warn_if_undelimited(*parts: str) -> None:
    """Warn of each name without brackets; names with special characters are an error."""
    for p in parts:
        if has_special_characters(p):
            raise ValueError(f"special characters in name {p!r}")
        if not is_delimited(p, "[]"):
            warnings.warn(f"name {p!r} is not delimited by []", stacklevel=3)


def db_schema(db: str = "", schema: str = "") -> str:
    """Database and schema joined by a dot; either may be empty, not both."""
    if not db and not schema:
        raise ValueError("database and schema are both empty")
    parts = [p for p in (db, schema) if p]
    warn_if_undelimited(*parts)
    return ".".join(parts)


def catalog_name(db: str = "[]", schema: str = "[]", table: str = "") -> str:
    """Spark name of a table: parts that are empty or '[]' are left out, the others quoted."""
    parts = [remove_delimiters(p, "[]") for p in (db or "", schema or "", table)]
    for p in parts:
        if has_special_characters(p):
            raise ValueError(f"special characters in name {p!r}")
    if not parts[-1]:
        raise ValueError("a table needs a name")
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts if p)


def inform(message: str, context: str | None = None, silent: bool = False) -> str:
    """A progress message with the time; context 'heading', 'details' or 'all' sets its form. Returned, and logged unless silent."""
    forms = {None: "{}", "heading": "{}", "details": " -- {}", "all": " ---- {}"}
    if context not in forms:
        raise ValueError("context is heading, details or all")
    text = message.upper() if context == "heading" else message
    line = f"{time.strftime('%Y-%m-%d %H:%M:%S')} | {forms[context].format(text)}"
    if not silent:
        log.info(line)
    return line
