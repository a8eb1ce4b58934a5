"""Product codes of vectors: per part a codebook, its entries moved by exact integer means.

Assignment keeps adaptive bounds. Each part of a vector remembers a few of its
closest entries with ordered lower bounds of their distances, an upper bound of
the distance to its own entry and one outer bound for all entries that are not
listed. When entries have moved, the bounds move with them; where the upper bound
stays below all lower bounds the entry is certain, otherwise exact integer
distances decide: to the listed entries whose bound is reached, or to all entries
when the outer bound is reached too. The number of listed entries adapts to what
the parts needed in the last round.

The bounds travel with their vectors as one table a round, written to the shared
folder. Only codebooks and their sums (entries x components) reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.files import drop_table, materialize, scratch_path

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Share of parts that the listed entries should serve without a full comparison.
SERVED = 0.95
_STATE = "vec_id {id}, label {label}, vec binary, own binary, near binary, low binary, used binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part: no null or non-finite component, the usual dimension."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.where(v.isNotNull() & ~bad) \
        .select(F.col(id_col).alias("vec_id"), label.alias("label"), v.cast("array<double>").alias("vec"))
    usual = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("vec") == (usual.dim if usual else 0))


def bound_of(dim: int) -> int:
    """Integer components are held within this, so that a vector's squared distance fits a long."""
    return 1 << max(1, (60 - max(dim, 1).bit_length()) // 2)


def _integers(column: pa.Array, dim: int, parts: int, scale: int) -> np.ndarray:
    """(row, part, component) integers; parts are padded with zeros when the dimension is no multiple of them."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    width = -(-dim // parts)
    out = np.zeros((len(x), parts * width), np.int32)
    out[:, :dim] = np.clip(x, -bound_of(dim), bound_of(dim))
    return out.reshape(len(x), parts, width)


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (n, w) to all entries (k, w)."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 52 else np.int64  # exact in either, faster as doubles
    x, book = x.astype(kind), book.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]).astype(np.int64)


def _below(d: np.ndarray) -> np.ndarray:
    return np.nextafter(d.astype(np.float32), np.float32(-np.inf))


def _above(d: np.ndarray) -> np.ndarray:
    return np.nextafter(d.astype(np.float32), np.float32(np.inf))


class Bounds:
    """State of one part position over a batch: own entry, listed entries, [upper, lower bounds.., outer bound], entries needed."""

    def __init__(self, own, near, low, used):
        self.own, self.near, self.low, self.used = own, near, low, used


def assign_all(x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
    """Full comparison; ties go to the lower index. ``b`` other entries are listed, fewer than there are entries."""
    d = _distances(x, book)
    own = d.argmin(1)
    every = np.arange(len(x))
    best = d[every, own]
    d[every, own] = np.iinfo(np.int64).max
    rest = np.argpartition(d, b, axis=1)[:, :b + 1] if b < d.shape[1] - 1 else np.argsort(d, axis=1, kind="stable")
    far = np.take_along_axis(d, rest, 1)
    order = far.argsort(1, kind="stable")
    rest, far = np.take_along_axis(rest, order, 1), np.take_along_axis(far, order, 1)
    outer = far[:, b:b + 1]
    roots = _below(np.sqrt(far[:, :b].astype(float)))
    outer = np.where(outer == np.iinfo(np.int64).max, np.float32(np.inf), _below(np.sqrt(outer.astype(float))))
    low = np.concatenate([_above(np.sqrt(best.astype(float)))[:, None], roots, outer], axis=1)
    return Bounds(own, rest[:, :b], low, np.full(len(x), b + 1, np.int64))


def assign_moved(x: np.ndarray, book: np.ndarray, moved: np.ndarray, state: Bounds, b: int) -> Bounds:
    """The assignment after the entries have moved by at most ``moved``; at most ``b`` entries stay listed."""
    own, near, had = state.own.copy(), state.near.copy(), state.near.shape[1]
    upper = _above(state.low[:, 0] + moved[own])
    bounds = np.concatenate([_below(state.low[:, 1:-1] - moved[near]), _below(state.low[:, -1:] - moved.max())], axis=1)
    ordered = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]
    used = np.zeros(len(x), np.int64)
    open_ = np.flatnonzero(upper >= ordered[:, 0])
    if len(open_):  # the exact distance to the own entry settles some of them
        exact = ((x[open_].astype(np.int64) - book[own[open_]]) ** 2).sum(1)
        upper[open_] = _above(np.sqrt(exact.astype(float)))
        need = (ordered[open_] <= upper[open_][:, None]).sum(1)  # bounds ascend, so these come first
        used[open_] = need
        for some in np.array_split(open_, max(1, len(open_) // 4096)):
            part = some[(used[some] > 0) & (used[some] <= had)]
            if len(part):
                self_d = ((x[part].astype(np.int64) - book[own[part]]) ** 2).sum(1)
                width = int(used[part].max())
                listed = near[part][:, :width]
                d = ((x[part].astype(np.int64)[:, None, :] - book[listed]) ** 2).sum(2)
                asked = np.arange(width) < used[part][:, None]
                ids = np.concatenate([own[part][:, None], near[part]], axis=1)
                dist = np.full(ids.shape, np.iinfo(np.int64).max)
                dist[:, 0] = self_d
                dist[:, 1:width + 1] = np.where(asked, d, dist[:, 1:width + 1])
                least = dist.min(1)
                winner = np.where(dist == least[:, None], ids, len(book)).min(1)
                at = (ids == winner[:, None]).argmax(1)
                lows = np.concatenate([np.zeros((len(part), 1), np.float32), bounds[part][:, :-1]], axis=1)
                known = dist != np.iinfo(np.int64).max
                lows = np.where(known, _below(np.sqrt(np.where(known, dist, 0).astype(float))), lows)
                rows = np.arange(len(part))
                lows[rows, at] = np.inf  # the winner leaves the list
                order = lows.argsort(1, kind="stable")[:, :had]
                near[part] = np.take_along_axis(ids, order, 1)
                bounds[part, :-1] = np.take_along_axis(lows, order, 1)
                own[part] = winner
                upper[part] = _above(np.sqrt(least.astype(float)))
        full = open_[used[open_] > had]
        if len(full):
            new = assign_all(x[full], book, had)
            own[full], near[full], upper[full], bounds[full] = new.own, new.near, new.low[:, 0], new.low[:, 1:]
    if b < had:
        order = bounds[:, :-1].argsort(1, kind="stable")
        near, listed = np.take_along_axis(near, order, 1), np.take_along_axis(bounds[:, :-1], order, 1)
        outer = np.minimum(bounds[:, -1], listed[:, b])
        near, bounds = near[:, :b], np.concatenate([listed[:, :b], outer[:, None]], axis=1)
    return Bounds(own, near, np.concatenate([upper[:, None], bounds], axis=1).astype(np.float32), used)


def _binary(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    step = m.nbytes // max(len(m), 1)
    raw = m.tobytes()
    return pa.array([raw[i * step:(i + 1) * step] for i in range(len(m))], pa.binary())


def _matrix(column: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _packed(batch: pa.RecordBatch, vec: np.ndarray, states: list[Bounds], names: list[str]) -> pa.RecordBatch:
    stack = lambda f, kind: _binary(np.stack([f(s) for s in states], axis=1).astype(kind))
    columns = [batch.column("vec_id"), batch.column("label"), _binary(vec), stack(lambda s: s.own, "<u2"), stack(lambda s: s.near, "<u2"),
               stack(lambda s: s.low, "<f4"), stack(lambda s: s.used, "<u2")]
    return pa.RecordBatch.from_arrays(columns, names=names)


class Codebooks:
    """Codebooks (part, entry, component) and how far each entry moved in the last update."""

    def __init__(self, books: np.ndarray, moved: np.ndarray | None = None):
        self.books, self.moved = books, moved

    def updated(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries become the floored means of their parts; unused ones stay."""
        new = np.where(counts[:, :, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, :, None]), self.books)
        step = (new - self.books).astype(float)
        return Codebooks(new, np.sqrt((step * step).sum(2)) * (1 + 1e-12))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _first_state(shared, dim: int, parts: int, scale: int, b: int, names: list[str]):
    def run(batches):
        books = shared.value.books
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch.column("vec"), dim, parts, scale)
                yield _packed(batch, x, [assign_all(x[:, p], books[p], b) for p in range(parts)], names)

    return run


def _unpacked(batch: pa.RecordBatch, parts: int, width: int, b: int):
    vec = _matrix(batch.column("vec"), "<i4", parts, width)
    own = _matrix(batch.column("own"), "<u2", parts).astype(np.int64)
    near = _matrix(batch.column("near"), "<u2", parts, b).astype(np.int64)
    return vec, [Bounds(own[:, p], near[:, p], low, None) for p, low in enumerate(np.moveaxis(_matrix(batch.column("low"), "<f4", parts, b + 2), 1, 0))]


def _next_state(shared, parts: int, width: int, had: int, b: int, names: list[str]):
    def run(batches):
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                x, states = _unpacked(batch, parts, width, had)
                yield _packed(batch, x, [assign_moved(x[:, p], c.books[p], c.moved[p], states[p], b) for p in range(parts)], names)

    return run


def _tally(parts: int, width: int, k: int, b: int):
    """Per task: counts and component sums of every entry, and how many listed entries the parts needed."""
    def run(batches):
        sums, counts, needed = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64), np.zeros(b + 2, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, own = _matrix(batch.column("vec"), "<i4", parts, width), _matrix(batch.column("own"), "<u2", parts)
                needed += np.bincount(np.minimum(_matrix(batch.column("used"), "<u2", parts).ravel(), b + 1), minlength=b + 2)
                for p in range(parts):
                    np.add.at(sums[p], own[:, p], x[:, p].astype(np.int64))
                    counts[p] += np.bincount(own[:, p], minlength=k)
        flat = np.concatenate([counts.ravel(), needed, sums.ravel()])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["slot", "total"])

    return run


def _coded(shared, parts: int, width: int, k: int):
    """vec_id, label, code (hex, ``digits`` a part) and the squared distance to the coded vector."""
    digits = max(2, -(-(k - 1).bit_length() // 4))

    def run(batches):
        books = shared.value.books
        for batch in batches:
            if batch.num_rows:
                x, own = _matrix(batch.column("vec"), "<i4", parts, width).astype(np.int64), _matrix(batch.column("own"), "<u2", parts)
                error = ((x - books[np.arange(parts), own]) ** 2).sum((1, 2))
                code = ["".join(f"{i:0{digits}x}" for i in row) for row in own.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error)],
                                                 names=["vec_id", "label", "code", "error"])

    return run


class Compressed:
    """``rows``: vec_id, label, code, error; ``codebooks``: the final :class:`Codebooks`; ``listed``: listed entries a round."""

    def __init__(self, rows: DataFrame, codebooks: Codebooks, listed: list[int]):
        self.rows, self.codebooks, self.listed = rows, codebooks, listed


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """Product codes of all vectors.

    Components become ``floor(scale * x)``, held within :func:`bound_of` the dimension;
    vectors are cut into ``parts`` equal parts (the last are padded with zeros when the
    dimension is no multiple). Codebooks start as the parts of the ``entries`` vectors of
    smallest id (ties: smallest vector), all of them if there are fewer. Equally near
    entries: the lower index.

    Vectors that are null, hold null or non-finite components or have another dimension
    than most take no part. A null id comes after all others and keeps its row; repeated
    rows all count and all get a code. Other columns play no part. An empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, label_col)
    kinds = dict(rows.dtypes)
    schema = _STATE.format(id=kinds["vec_id"], label=kinds["label"])
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    dim = len(first[0].vec) if first else parts
    k, width = max(len(first), 1), max(1, -(-dim // parts))
    table = pa.array([r.vec for r in first], pa.list_(pa.float64()))
    books = np.moveaxis(_integers(table, dim, parts, scale).astype(np.int64), 0, 1) if first else np.zeros((parts, 1, width), np.int64)
    current, b = Codebooks(books), min(max(1, k // 8), k - 1)
    share = spark.sparkContext.broadcast  # codebooks: entries x components, whatever the table's size
    shared, listed, old = share(current), [], None
    for r in range(rounds + 1):
        path = scratch_path(spark, "codes")
        if r == 0:
            state = rows.mapInArrow(_first_state(shared, dim, parts, scale, b, names), schema)
            had = b
        else:
            state = state.mapInArrow(_next_state(shared, parts, width, had, b, names), schema)
            had = b
        state = materialize(state, path)
        if old:
            drop_table(spark, old)
        old = path
        listed.append(had)
        if r == rounds:
            break
        totals = state.mapInArrow(_tally(parts, width, k, had), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
        flat = np.zeros(parts * k + had + 2 + parts * k * width, np.int64)
        for row in totals:
            flat[row.slot] = row.total
        counts, needed, sums = np.split(flat, [parts * k, parts * k + had + 2])
        current = current.updated(sums.reshape(parts, k, width), counts.reshape(parts, k))
        if r:  # after the first, full comparison: as many entries as served most parts
            b = min(had, max(1, int(np.searchsorted(np.cumsum(needed), SERVED * needed.sum()))))
        shared.unpersist()
        shared = share(current)
    coded = state.mapInArrow(_coded(shared, parts, width, k), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    return Compressed(coded, current, listed)


def with_group_totals(rows: DataFrame, key: str, value: str, total: str, hot: int = 1000) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal ``key`` (nulls together).

    Keys that hold more than one in ``hot`` rows - fewer than ``hot`` of them, so their sums
    are broadcast - are looked up in place; only rows of rarer keys are shuffled to theirs.
    """
    sums = rows.groupBy(key).agg(F.try_sum(value).alias(total), F.count(F.lit(1)).alias("__n"))
    sums = materialize(sums.withColumnRenamed(key, "__key"))
    share = F.lit(rows.count() / hot)
    frequent = sums.where(F.col("__n") > share).select("__key", total, F.lit(True).alias("__hot"))
    looked = rows.join(F.broadcast(frequent), rows[key].eqNullSafe(frequent["__key"]), "left").drop("__key")
    rare = sums.where(F.col("__n") <= share).select("__key", F.col(total).alias("__total"))
    done = looked.where("__hot").drop("__hot")
    rest = looked.where("__hot IS NULL").drop("__hot", total)
    rest = rest.join(rare, rest[key].eqNullSafe(rare["__key"])).drop("__key").withColumnRenamed("__total", total)
    return done.unionByName(rest)


def compressed_report(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **how) -> DataFrame:
    """Per vector: id, code, error, ``label_error`` (errors of equal labels, nulls together; null beyond a long) and ``codebooks_sha256``."""
    done = compress(vectors, id_col, vec_col, label_col, **how)
    rows = with_group_totals(materialize(done.rows), "label", "error", "label_error")
    return rows.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(done.codebooks.digest()).alias("codebooks_sha256"))
