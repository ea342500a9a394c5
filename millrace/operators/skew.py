"""Hot keys: find the keys that hold more rows than one task should take, and spread them.

Ordinary joins are left to adaptive execution, which splits skewed shuffle partitions at run time.
These helpers are for layouts that it cannot split afterwards, such as bucketed tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import stored

ROWS_PER_TASK = 5_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """``(keys..., n_salts)`` for every key with more rows than a task should take, or None when there is none.

    Counting combines before the shuffle. A key gets one salt for each ``rows_per_task`` rows, so all
    keys above the limit are split, however many there are.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter(F.col("n") > rows_per_task)
    found = stored(hot.select(*keys, F.ceil(F.col("n") / rows_per_task).cast("int").alias("n_salts")))
    return None if found.isEmpty() else found


def _with_salts(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """``df`` with ``n_salts`` of its keys; NULL keys match each other. Spark broadcasts ``hot`` where it is small."""
    renamed = hot.select(*(F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)), "n_salts")
    same = reduce(and_, (df[k].eqNullSafe(renamed[f"_hot_{i}"]) for i, k in enumerate(keys)))
    return df.join(renamed, same, "left").withColumn("n_salts", F.coalesce("n_salts", F.lit(1)))


def add_salt(df: DataFrame, keys: Sequence[str], spread: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """Rows of a hot key get a ``salt`` from the hash of the ``spread`` columns; all others get 0."""
    if hot is None:
        return df.withColumn("salt", F.lit(0))
    salt = F.pmod(F.xxhash64(*spread), F.col("n_salts")).cast("int")
    return _with_salts(df, keys, hot).select(*df.columns, salt.alias("salt"))


def repeat_for_salts(df: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """The other side of a salted join: one row per salt of a hot key."""
    if hot is None:
        return df.withColumn("salt", F.lit(0))
    salts = F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1))
    return _with_salts(df, keys, hot).select(*df.columns, salts.alias("salt"))


def join_many_to_one(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join rows to their one match by key; a key that holds much of ``many`` is spread by salt.

    ``how`` is inner, left, left_semi or left_anti. The other kinds would return an unmatched row of ``one`` per salt.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"a many-to-one join cannot be {how!r}")
    hot = hot_keys(many, keys, rows_per_task)
    if hot is None:
        return many.join(one, list(keys), how)
    rest = spread or [c for c in many.columns if c not in keys]
    left = add_salt(many, keys, rest, hot)
    right = repeat_for_salts(one, keys, hot)
    return left.join(right, [*keys, "salt"], how).drop("salt")
