"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors are scaled to length one, projected to a few random directions, shifted
at random and ordered along a Hilbert curve; this is done for several curves, each
with directions and a shift of its own. Spark numbers the places on all curves
by one range-partitioned sort. The candidates of a query are the vectors within
``window`` places of it, before or after, on any curve, and are ranked by their
exact cosine. Places are cut into blocks of ``BLOCK`` vectors, and a query visits
the blocks of its window, so a task holds one block and streams its queries.

Equal vectors, and multiples by powers of two, are one point of the index that keeps its
``k + 1`` smallest ids; of other equally near points all stay until ids decide.
``window`` is a share of the points: recall then holds at every size, and a query
is compared with at most ``2 * window * curves`` of the points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.hilbert import hilbert_keys
from quarry.plans.prefix import range_numbered
from quarry.sources.files import materialize

CURVES, WINDOW = 32, 0.01
DIMS, BITS, BLOCK = 8, 6, 1024
#: Points this close to the last one kept stay too, until exact scores and ids decide.
EVEN = 1e-12


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: an id, no null or non-finite component, not zero, the usual dimension."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & some) \
        .select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))
    usual = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("vec") == (usual.dim if usual else 0))


def to_scale(rows: DataFrame) -> DataFrame:
    """``vec`` divided by a power of two near its largest component: exact, so cosines stay and such multiples become equal."""
    top = F.array_max(F.transform("vec", F.abs))
    return rows.withColumn("vec", F.transform("vec", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(top)))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def curve_keys(points: DataFrame, dim: int, curves: int, seed: int = 5) -> DataFrame:
    """(curve, key, point) of every point on every curve."""
    rng = np.random.default_rng(seed)
    dims = min(DIMS, dim)
    ways = [(np.linalg.qr(rng.normal(size=(dim, dims)))[0], rng.uniform(0, 1, dims)) for _ in range(curves)]
    reach = min(1.0, 4 / dim ** 0.5)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _unit(_matrix(batch.column("vec"), dim))
            for c, (directions, shift) in enumerate(ways):
                at = ((m @ directions / reach + 1) / 2 + shift) / 2 * (1 << BITS)
                keys = hilbert_keys(np.clip(at, 0, (1 << BITS) - 1).astype(np.int64), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), batch.column("point")],
                                                 names=["curve", "key", "point"])

    return points.select("point", "vec").mapInArrow(run, "curve int, key long, point long")


def _scan(dim: int, k: int):
    """Ranks the queries of each block (kind 1) against its points (kind 0), which come first and are at most ``BLOCK``."""

    def run(batches):
        block, ids, held = None, [], []
        for batch in batches:
            where = list(zip(batch.column("curve").to_pylist(), batch.column("block").to_pylist(), strict=True))
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            point = batch.column("point").to_numpy(zero_copy_only=False)
            m = _unit(_matrix(batch.column("vec"), dim)) if batch.num_rows else None
            i = 0
            while i < len(where):
                j = i
                while j < len(where) and where[j] == where[i] and kind[j] == kind[i]:
                    j += 1
                if where[i] != block:
                    block, ids, held = where[i], [], []
                if kind[i] == 0:
                    ids.append(point[i:j])
                    held.append(m[i:j])
                elif held:
                    if len(held) > 1:
                        ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                    for a in range(i, j, 1024):
                        s = m[a:min(j, a + 1024)] @ held[0].T
                        least = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] if s.shape[1] > k + 1 else np.full(len(s), -2.0)
                        row, best = np.nonzero(s >= least[:, None] - EVEN)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(point[a:min(j, a + 1024)][row]), pa.array(ids[0][best]), pa.array(s[row, best])], names=["query", "point", "near"])
                i = j

    return run


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
            curves: int = CURVES, window: float = WINDOW) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), the neighbour's id, and score, its exact cosine.

    ``queries`` is a condition on the id column; a query's candidates are all rows
    but its own (rows with its id); an id with several vectors counts with its nearest. Ties go to the smaller id. Vectors that are
    null, zero, hold null or non-finite components, have another dimension than
    most, or no id, take no part. Repeated rows count once; other columns play no
    part; an empty table gives an empty result.
    """
    rows = materialize(to_scale(valid(vectors, id_col, vec_col)))
    asks = rows.select(F.col("id").alias(id_col), "vec").where(queries).select(F.col(id_col).alias("query_id"), "vec").distinct()
    few = rows.select("id", "vec").withColumn("place", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))) \
        .where(F.col("place") <= k + 1)
    points = few.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("point", F.monotonically_increasing_id())
    points = materialize(points)
    n, dim = points.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    asking = materialize(asks.join(points.select("vec", "point"), "vec").select("query_id", "point"))
    reach = max(1, int(np.ceil(window * n)))
    places = range_numbered(curve_keys(points, dim or 1, curves), ["curve", "key", "point"], "place")
    place = F.col("place") - 1 - F.col("curve").cast("long") * n
    places = places.select("curve", "point", place.alias("at"))
    block = lambda at: F.floor(at / BLOCK)
    theirs = places.select("curve", block(F.col("at")).alias("block"), "point", F.lit(0).alias("kind"))
    low, high = F.greatest(F.col("at") - reach, F.lit(0)), F.least(F.col("at") + reach, F.lit(max(n, 1) - 1))
    ours = places.join(asking.select("point").distinct(), "point") \
        .select("curve", F.explode(F.sequence(block(low), block(high))).alias("block"), "point", F.lit(1).alias("kind"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = theirs.unionByName(ours).join(points.select("point", "vec"), "point") \
        .repartition(parts, "curve", "block").sortWithinPartitions("curve", "block", "kind")
    found = both.select("curve", "block", "kind", "point", "vec").mapInArrow(_scan(dim or 1, k), "query long, point long, near double") \
        .groupBy("query", "point").agg(F.max("near").alias("near"))
    best = Window.partitionBy("query").orderBy(F.desc("near")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # k + 1 points hold k neighbours beside the query's own point; those as near as the last of them stay too.
    found = found.withColumn("least", F.nth_value("near", k + 1).over(best)).where(F.col("least").isNull() | (F.col("near") >= F.col("least") - EVEN)).drop("least")
    found = materialize(found)
    side = lambda p, v: points.select(F.col("point").alias(p), F.col("vec").alias(v))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot("qv", "pv") / (F.sqrt(dot("qv", "qv")) * F.sqrt(dot("pv", "pv")))
    exact = found.join(side("query", "qv"), "query").join(points.select("point", F.col("vec").alias("pv"), "ids"), "point") \
        .select(F.col("query").alias("point"), score.alias("score"), F.explode("ids").alias("near_id"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "near_id")
    return asking.join(exact, "point").where(F.col("near_id") != F.col("query_id")) \
        .groupBy("query_id", "near_id").agg(F.max("score").alias("score")) \
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("near_id").alias(id_col), "score")
