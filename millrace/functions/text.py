"""String helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the log cleaner removes.
MARKUP_PATTERN = r"\[/?[a-z]+\]"
ANSI_PATTERN = "\x1b[^m]*m"
RULE_LINE_PATTERN = "^─+$"


def text_append(*parts: Column) -> Column:
    """Parts joined by a line break; NULL if any part is NULL, since a missing input is an error."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit("\n"), part] if pieces else [part]
    return F.concat(*pieces)


def string_tail(text: Column, length: int) -> Column:
    """The last ``length`` characters; a shorter text comes back whole."""
    return F.right(text, F.lit(length))


def file_slug(name: Column, suffix: str = ".txt") -> Column:
    return F.concat(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit(suffix))


def module_path(path: Column) -> Column:
    """Path without its ``.py`` ending."""
    return F.regexp_replace(path, r"\.py$", "")


def path_parts(path: Column) -> Column:
    """``struct(module, parent, leaf, depth)`` of a relative source path."""
    module = module_path(path)
    parts = F.split(module, "/")
    parent = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    return F.struct(
        module.alias("module"),
        F.when(F.size(parts) > 1, parent).alias("parent"),
        F.element_at(parts, -1).alias("leaf"),
        F.size(parts).alias("depth"),
    )


def strip_markup(text: Column) -> Column:
    return F.regexp_replace(text, MARKUP_PATTERN, "")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI_PATTERN, "")


def is_rule_line(text: Column) -> Column:
    """True for the horizontal rules that separate sections of a log."""
    return text.rlike(RULE_LINE_PATTERN)
