"""Exact top-k search by largest inner product: vectors in order of length, partial sums after an SVD rotation.

Vectors are integers held in doubles. The right singular vectors of the whole table rotate them, so that the first coordinates
carry most of an inner product. A task takes a lane of candidates in descending length and a group of queries:

* ``|q| |c|`` bounds a score. Once no query of the group can gain by it, the rest of the lane is shorter still and is passed over.
* The partial sum over the first coordinates plus the product of the two residual lengths bounds it more closely (Cauchy-Schwarz).
  Pairs below a query's k-th best score are dropped at each of several depths; only the others get their exact product.
* Every lane starts from the k-th best score among the ``SEEDS`` longest vectors of all.

Bounds are compared with some slack for rounding, scores are exact, so pruning never changes a result.

Scale. Candidates are dealt to lanes by a hash of row and id, queries to groups of about ``GROUP_QUERIES``; each candidate goes once to each
group of queries, each query once to each lane, and leaves at most ``k`` rows there. A lane is read as a stream. The driver sees the
second moments (the square of the width) and the seeds.

Defined cases: rows without an id, and vectors that are NULL or hold NULL or non-finite components take no part; nor do vectors of
another length than the most frequent one (the smaller of equally frequent ones). Zero vectors take part. Every row is a candidate, equal
rows as well; a query finds no row with its own id. Query rows equal in id and vector ask once. Ties go to the smaller id.
A score beyond 64 bits counts as the nearest 64-bit integer. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.store import Scratch
from millrace.session import shuffle_partitions

GROUP_QUERIES = 8192
LANE_ROWS = 65536
SEEDS = 1024
BLOCK_ROWS = 512
#: Depths, as shares of the width, at which partial sums are compared with the bound.
DEPTHS = (0.125, 0.25, 0.5)
#: Up to this share of remaining pairs they are taken one by one, above it a block's products are taken at once.
FEW = 1 / 16
NONE = np.iinfo(np.int64).min


def quantised(scale: int = 256):
    """``floor(scale * x)``, as doubles."""
    return lambda x: np.floor(scale * x)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _prepared(rows: DataFrame, width: int, change) -> DataFrame:
    """``vec_id, asks, vector, norm`` after ``change``; vectors that it makes non-finite are left out."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                y = change(_matrix(batch.column(2), width))
            good = np.isfinite(y).all(axis=1)
            batch, y = batch.filter(pa.array(good)), y[good]
            ends = pa.array(width * np.arange(len(y) + 1, dtype=np.int32))
            vectors = pa.ListArray.from_arrays(ends, pa.array(y.ravel()))
            with np.errstate(over="ignore"):
                norms = pa.array(np.sqrt((y * y).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors, norms], names=["vec_id", "asks", "vector", "norm"])

    return rows.mapInArrow(prepare, "vec_id long, asks boolean, vector array<double>, norm double")


def _rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of the table, largest singular value first, from sums of its second moments."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = _matrix(batch.column(0), width)
            with np.errstate(over="ignore", invalid="ignore"):
                total += y.T @ y
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, total)], names=["i", "j", "s"])

    sums = rows.select("vector").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    moment = np.zeros((width, width))
    for row in sums.collect():
        moment[row.i, row.j] = row.s
    if not np.isfinite(moment).all():
        return np.eye(width)
    return np.linalg.eigh(moment)[1][:, ::-1]


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``x`` with the same rows of ``y``, both integers in doubles."""
    if not len(x):
        return np.zeros(0, np.int64)
    most = x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0))
    if most < 2.0**53:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    if most < 2.0**62 and max(np.abs(x).max(), np.abs(y).max()) < 2.0**62:
        return np.einsum("ij,ij->i", x.astype(np.int64), y.astype(np.int64))
    sums = [sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
    return np.array([max(NONE + 1, min(np.iinfo(np.int64).max, s)) for s in sums], np.int64)


class Group:
    """A group of queries with their best candidates so far."""

    def __init__(self, asking: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, rotation: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]):
        self.asking, self.ids, self.vectors, self.k, self.rotation = asking, ids, vectors, k, rotation
        self.turned = vectors @ rotation
        width = vectors.shape[1]
        self.depths = sorted({max(1, round(width * d)) for d in DEPTHS} - {width}) if width else []
        self.rest = self._rests(self.turned)
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.largest = float(np.abs(vectors).max(initial=0))
        self.best = np.full((len(ids), k), NONE)
        self.found = np.zeros((len(ids), k), np.int64)
        self.bound = np.full(len(ids), NONE)  # a score below this is not among the k best
        self._seed(*seeds)

    def _rests(self, turned: np.ndarray) -> list[np.ndarray]:
        """Lengths of the coordinates from each depth on."""
        return [np.sqrt((turned[:, d:] ** 2).sum(axis=1)) for d in self.depths]

    def _seed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if len(ids) < self.k:
            return
        for low in range(0, len(self.ids), 1024):
            part = slice(low, low + 1024)
            scores = self._all(self.vectors[part], vectors)
            if scores is None:
                return
            scores[self.ids[part, None] == ids] = NONE
            self.bound[part] = np.partition(scores, -self.k, axis=1)[:, -self.k]

    def _all(self, x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
        """All exact products of two blocks, or None where doubles don't hold them."""
        if x.shape[1] * self.largest * float(np.abs(y).max(initial=0)) >= 2.0**53:
            return None
        return (x @ y.T).astype(np.int64)

    def offer(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> bool:
        """Candidates in descending length. False when neither these nor any shorter ones can be among the best."""
        wanted = self.bound - 1e-9 * self.norms * norms[0]
        wanted[self.bound == NONE] = -np.inf
        active = np.flatnonzero(~(self.norms * norms[0] < wanted))
        if not len(active):
            return False
        wanted, turned = wanted[active], vectors @ self.rotation
        rests = self._rests(turned)
        if not self.depths:
            self._all_pairs(active, ids, vectors, np.ones((len(active), len(ids)), bool))
            return True
        d = self.depths[0]
        sums = self.turned[active, :d] @ turned[:, :d].T
        alive = ~(sums + self.rest[0][active, None] * rests[0] < wanted[:, None])
        if alive.sum() > FEW * alive.size:
            self._all_pairs(active, ids, vectors, alive)
            return True
        i, j = np.nonzero(alive)
        s = sums[i, j]
        for depth, more in enumerate(self.depths[1:], 1):
            s += np.einsum("ij,ij->i", self.turned[active[i], d:more], turned[j, d:more])
            kept = ~(s + self.rest[depth][active[i]] * rests[depth][j] < wanted[i])
            i, j, s, d = i[kept], j[kept], s[kept], more
        self._take(active[i], ids[j], exact_scores(self.vectors[active[i]], vectors[j]))
        return True

    def _all_pairs(self, active: np.ndarray, ids: np.ndarray, vectors: np.ndarray, alive: np.ndarray) -> None:
        scores = self._all(self.vectors[active], vectors)
        if scores is None:
            for low in range(0, len(active), 64):
                i, j = np.nonzero(alive[low : low + 64])
                self._take(active[i + low], ids[j], exact_scores(self.vectors[active[i + low]], vectors[j]))
            return
        if len(ids) > self.k + 1 and (self.bound[active] == NONE).any():
            scores[self.ids[active, None] == ids] = NONE
            self.bound[active] = np.maximum(self.bound[active], np.partition(scores, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(alive & (scores >= self.bound[active, None]))
        self._take(active[i], ids[j], scores[i, j])

    def _take(self, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores >= self.bound[i]) & (self.ids[i] != ids)
        if not good.any():
            return
        i, ids, scores = i[good], ids[good], scores[good]
        who = np.unique(i)
        i = np.concatenate([np.repeat(who, self.k), i])
        ids, scores = np.concatenate([self.found[who].ravel(), ids]), np.concatenate([self.best[who].ravel(), scores])
        by = np.lexsort((ids, ~scores, i))
        i, ids, scores = i[by], ids[by], scores[by]
        first = np.searchsorted(i, who)
        place = first[:, None] + np.arange(self.k)
        self.best[who], self.found[who] = scores[place], ids[place]
        self.bound[who] = np.maximum(self.bound[who], self.best[who, -1])

    def result(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.best > NONE)
        arrays = [self.asking[i], self.ids[i], self.found[i, j], self.best[i, j]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["asking", "query_id", "vec_id", "score"])


def top_inner_products(
    vectors: DataFrame, asks: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", change=None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each row where ``asks`` holds.

    ``change`` makes integer-valued doubles of a matrix of components; without it they are rounded down.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(id_column).cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("vector")
    )
    sizes = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = sizes.n if sizes else 0
    rows = scratch.write(_prepared(usable.filter(F.size("vector") == width), width, change or np.floor), "prepared")
    rotation = _rotation(rows, width)
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "vector").collect()
    seeds = (np.array([r.vec_id for r in longest], np.int64), np.array([r.vector for r in longest], np.float64).reshape(len(longest), width))
    asking = rows.filter("asks").select("vec_id", "vector").distinct().withColumn("asking", F.monotonically_increasing_id())
    asking = scratch.write(asking, "asking")
    groups = max(1, -(-asking.count() // GROUP_QUERIES))
    lanes = max(shuffle_partitions(spark), -(-rows.count() // LANE_ROWS))
    shared = spark.sparkContext.broadcast((rotation, *seeds))

    queries = asking.select(
        F.pmod(F.xxhash64("asking"), F.lit(groups)).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        F.lit(0).alias("kind"),
        "asking",
        "vec_id",
        "vector",
        F.lit(0.0).alias("norm"),
    )
    # Rows that share an id are dealt to different lanes, too.
    candidates = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(lanes)).cast("int").alias("lane"),
        F.lit(1).alias("kind"),
        F.lit(0).cast("long").alias("asking"),
        "vec_id",
        "vector",
        "norm",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, *seed = shared.value
        key, parts, group, going = None, [], None, False
        for batch in batches:
            number, lane, kind, who, ids = (batch.column(i).to_numpy() for i in range(5))
            y, norms = _matrix(batch.column(5), width), batch.column(6).to_numpy()
            change_ = np.flatnonzero((number[1:] != number[:-1]) | (lane[1:] != lane[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *change_.tolist()], [*change_.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if (number[a], lane[a]) != key:
                    if group is not None:
                        yield group.result()
                    key, parts, group, going = (number[a], lane[a]), [], None, True
                if kind[a] == 0:
                    parts.append((who[a:b].copy(), ids[a:b].copy(), y[a:b].copy()))
                    continue
                if group is None and parts:
                    group = Group(*(np.concatenate(x) for x in zip(*parts, strict=True)), k, turn, seed)
                    parts = []
                for low in range(a, b, BLOCK_ROWS):
                    if group is None or not going:
                        break
                    part = slice(low, min(low + BLOCK_ROWS, b))
                    going = group.offer(ids[part], y[part], norms[part])
        if group is not None:
            yield group.result()

    dealt = queries.union(candidates).repartition(lanes, "group", "lane")
    dealt = dealt.sortWithinPartitions("group", "lane", "kind", F.desc("norm"), "vec_id")
    found = dealt.mapInArrow(search, "asking long, query_id long, vec_id long, score long")
    best = Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
