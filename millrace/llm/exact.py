"""Exact duplicates: an immutable snapshot is screened by static filters, then compared byte by byte.

The distinct digests of a snapshot are dealt to buckets of bounded size, and every bucket gets a binary-fuse
filter. Rows of a new batch are first grouped by digest among themselves. Each distinct digest of the batch asks
the filter of its bucket: negatives are new, positives join the exact bucket, where a false positive finds no partner.
Texts whose digests meet, in the batch, in the snapshot or between them, are compared byte by byte
by grouping on the text itself, which combines before it shuffles, so a group with a third of all rows is split.

Defined cases: a NULL text counts as empty. Exactly one row of each group of equal texts stays, the one with
the largest doc_id; NULL ids come last, and of rows equal in doc_id and text any one stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm import fuse
from millrace.llm.store import Scratch, fresh

BUCKET_KEYS = 50_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _keys(digests: pd.Series) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(x[:8].ljust(8, b"\0") for x in digests), np.uint64)


def _bucket(count: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(max(1, -(-count // BUCKET_KEYS)))).cast("int")


def _groups(rows: DataFrame) -> DataFrame:
    """One row for each digest: the row that stays, the number of rows."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "tag")).alias("keep"), F.count("*").alias("size"))


def snapshot_filters(snapshot: DataFrame, buckets: Column) -> DataFrame:
    """``bucket, filter`` over the digests of a snapshot."""

    def make(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "filter": [fuse.build(np.unique(_keys(group["digest"])))]})

    return snapshot.select("digest", buckets.alias("bucket")).groupBy("bucket").applyInPandas(make, "bucket int, filter binary")


def screened(batch: DataFrame, filters: DataFrame, buckets: Column) -> DataFrame:
    """The distinct digests of a batch, and whether the snapshot may hold them."""

    def probe(key: tuple, digests: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        known = fuse.contains(found["filter"].iloc[0], _keys(digests["digest"])) if len(found) and len(digests) else np.zeros(len(digests), bool)
        return pd.DataFrame({"digest": digests["digest"], "positive": known})

    dealt = batch.select("digest", buckets.alias("bucket")).groupBy("bucket")
    return dealt.cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest binary, positive boolean")


def duplicate_groups(docs: DataFrame, in_snapshot: Column, digest=sha256) -> DataFrame:
    """``doc_id, digest, keep_id, group_size, kept`` for each row of ``docs`` (``doc_id``, ``text``).

    ``in_snapshot`` tells the rows of the snapshot from those of the new batch. ``digest`` makes a
    binary digest of a text column; texts that differ under equal digests are kept apart.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    # The tag is fixed by writing it; it tells rows of equal id and text apart.
    rows = scratch.write(named.select("doc_id", "old", digest(F.col("text")).alias("digest")).withColumn("tag", F.monotonically_increasing_id()), "rows")
    snapshot = scratch.write(_groups(rows.filter("old")), "snapshot")
    batch = scratch.write(_groups(rows.filter("not old")), "batch")
    buckets = _bucket(max(snapshot.count(), batch.count()))
    filters = scratch.write(snapshot_filters(snapshot, buckets), "filters")
    asked = scratch.write(screened(batch, filters, buckets), "screened")
    maybe = batch.join(asked.filter("positive").select("digest"), "digest", "left_semi")
    new = batch.join(asked.filter("positive").select("digest"), "digest", "left_anti")
    met = snapshot.select("digest", F.col("keep").alias("k"), F.col("size").alias("s")).join(maybe, "digest", "full")
    groups = met.select(
        "digest", F.greatest("k", "keep").alias("keep"), (F.coalesce("s", F.lit(0)) + F.coalesce("size", F.lit(0))).alias("size")
    ).union(new.select("digest", "keep", "size"))
    groups = scratch.write(groups, "groups")
    # Bytes: equal texts of a digest fall together; a digest with several texts is a collision.
    several = groups.filter("size > 1").select("digest")
    texts = named.select("text", digest(F.col("text")).alias("digest")).join(several.hint("shuffle_hash"), "digest", "left_semi")
    distinct = texts.groupBy("digest", "text").agg(F.count("*").alias("copies"))
    clashing = scratch.write(distinct.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "clashing")
    alone = groups if clashing.isEmpty() else groups.join(clashing, "digest", "left_anti")
    out = rows.join(alone, "digest")
    columns = ("doc_id", "digest", "tag", "keep", "size")
    out = out.select(*columns)
    if not clashing.isEmpty():
        # Only with a weak digest: these texts are told apart by their bytes.
        apart = named.withColumn("digest", digest(F.col("text"))).join(clashing, "digest", "left_semi").withColumn("tag", F.monotonically_increasing_id())
        apart = scratch.write(apart, "apart")
        by_text = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "tag")).alias("keep"), F.count("*").alias("size"))
        out = out.union(apart.join(by_text, ["digest", "text"]).select(*columns))
    return out.select(
        "doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("tag") == F.col("keep.tag")).alias("kept"),
    )


def without_duplicates(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = duplicate_groups(docs, in_snapshot).filter("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    name = fresh(docs, "digest")
    rows = docs.withColumn(name, sha256(F.coalesce("text", F.lit(""))))
    same = rows["doc_id"].cast("long").eqNullSafe(found["_id"]) & (rows[name] == found["_digest"])
    kept = rows.join(found.hint("shuffle_hash"), same, "left_semi")
    # Rows of equal id and text lie in one partition already; one of them stays.
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    if not twice.isEmpty():
        kept = kept.dropDuplicates(["doc_id", name])
    return kept.drop(name)
