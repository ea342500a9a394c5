"""Run parameters: lookup with a default, merge, and text forms. All are column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def ctx_lookup(ctx: Column, key: str, default: Any = None) -> Column:
    """Value of ``key``, or ``default`` when the key is missing."""
    return F.when(F.map_contains_key(ctx, F.lit(key)), F.try_element_at(ctx, F.lit(key))).otherwise(F.lit(default))


def ctx_merge(base: Column, override: Column) -> Column:
    """Union of two maps in which ``override`` wins. A NULL side counts as empty."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k))
    return F.coalesce(F.map_concat(kept, override), override, base)


def ctx_stringify(ctx: Column) -> Column:
    """Every value as text, spelled as the ledger stores it (``True``, ``False``, ``None``)."""

    def as_text(_: Column, value: Column) -> Column:
        text = value.cast("string")
        text = F.when(F.typeof(value) == "boolean", F.initcap(text)).otherwise(text)
        return F.coalesce(text, F.lit("None"))

    return F.transform_values(ctx, as_text)


def json_to_map(text: Column, strict: bool = False) -> Column:
    """JSON object text to a string map. ``strict`` fails the job on bad JSON, else it gives NULL."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return F.from_json(text, "map<string,string>", {"mode": mode})


def merged_parameters(project: Mapping[str, Any] | None, runtime: Mapping[str, Any] | None) -> dict[str, Any]:
    """Driver-side form of :func:`ctx_merge`, for ``spark.sql(text, args=...)``."""
    return {**(project or {}), **(runtime or {})}
