"""Distributed ordered scans: global row numbers, keyed running sums, shifts, as-of lookups.

A plain ``row_number().over(Window.orderBy(...))`` runs in ONE task, and a
``Window.partitionBy(key)`` puts every row of a hot key into one task. The scans
here deal rows by ranges of the whole order (key, then order columns), so a key,
a date or the rows without a date never form one task as long as their rows differ
in the order:

1. the rows are range-partitioned and sorted by key and order, and written once,
   because range bounds come from a sample and must not be drawn again;
2. every part reduces to an associative carry: its first and last key, and the
   totals of the last key's rows;
3. the carries, one row a part, are scanned: a part whose first key continues the
   key of the part before starts from that key's totals so far;
4. windows by (part, key) give the running values inside each part, and the carry,
   broadcast with one row a part, is added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.files import materialize

_PART, _AT = "__part", "__at"
#: Rows of a part, about: the parts grow in number, not in size.
ROWS_PER_PART = 125_000


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def parts_for(df: DataFrame, rows: int) -> int:
    """Partitions of a shuffle of ``rows`` rows: the session's number, and more where parts would hold too many rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PART))


def bounded(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` as it is if few rows, or dealt by ``keys`` to as many partitions as ``rows`` rows need, which are not joined again."""
    small = rows <= ROWS_PER_PART * df.sparkSession.sparkContext.defaultParallelism
    return df if small else df.repartition(parts_for(df, rows), *keys)


def ordered_parts(df: DataFrame, order: Sequence[Column | str], rows: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of ``order`` and sorted, as a written table with the part (``__part``) and the place in it (``__at``)."""
    parts = parts_for(df, df.count() if rows is None else rows)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(df.repartitionByRange(parts, *_cols(order)).sortWithinPartitions(*_cols(order))
                       .withColumns({_PART: F.spark_partition_id(), _AT: at}))


def _key(columns: Sequence[str], of: str | None = None) -> Column:
    """The values of a key's columns as one value, from the row or from the struct column ``of``."""
    return F.struct(F.lit(0).alias("_"), *[(F.col(f"{of}.{c}") if of else F.col(c)).alias(c) for c in columns])


def _carries(done: DataFrame, levels: dict[str, list[str]], measures: Sequence[str]) -> DataFrame:
    """One row a part: its first key, and per level and measure the total that the first key has from earlier parts.

    Levels are ever longer prefixes of the same order; all are read in one pass over the parts.
    """
    full = max(levels.values(), key=len)
    ends = done.groupBy(_PART).agg(F.min_by(_key(full), _AT).alias("__first"), F.max_by(_key(full), _AT).alias("__last"))
    tail = done.join(F.broadcast(ends), _PART).groupBy(_PART, "__first", "__last").agg(
        *[F.sum(F.when(_key(level).eqNullSafe(_key(level, "__last")), F.col(m))).alias(m + tag) for tag, level in levels.items() for m in measures])
    before = Window.orderBy(_PART)  # one row a part
    carries = []
    for tag, level in levels.items():
        so_far = Window.partitionBy(_key(level, "__last")).orderBy(_PART)
        tail = tail.withColumns({f"__c_{m}{tag}": F.sum(m + tag).over(so_far) for m in measures})
        goes_on = F.lag(_key(level, "__last")).over(before).eqNullSafe(_key(level, "__first"))
        carries += [F.when(goes_on, F.lag(f"__c_{m}{tag}").over(before)).alias(f"__c_{m}{tag}") for m in measures]
    return tail.select(_PART, "__first", *carries)


def keyed_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column],
                  count_name: str | None = None, frame: str = "rows", reset_keys: Sequence[str] = (),
                  reset_suffix: str = "_reset", rows: int | None = None) -> DataFrame:
    """Running sums per ``keys`` ordered by ``order``, by one segmented scan (see the module's text).

    ``sums`` maps output names to the columns to accumulate; ``count_name``
    adds the running row count (a 1-based row index per key for ``rows``).
    ``frame='range'`` gives RANGE semantics (peers share the value, as the
    SQL default frame); ``'rows'`` gives ROWS UNBOUNDED PRECEDING. For ``range``
    the rows are first reduced to one per key and order, and learn the result
    by an equi-join, so peers need not lie in one part.

    ``reset_keys`` order the rows of a key before ``order`` (e.g. the season) and
    additionally yield ``<name><reset_suffix>``: the same running sums restarted at
    every new ``keys + reset_keys`` group, from the same written table. ``rows`` is the
    number of rows, if known; else they are counted.
    """
    keys, reset_keys = list(keys), list(reset_keys)
    measures = {f"__m_{n}": c for n, c in sums.items()}
    if count_name:
        measures[f"__m_{count_name}"] = F.lit(1)
    if frame == "range":
        return _range_running(df, keys, order, dict(sums), count_name)
    done = ordered_parts(df.withColumns(measures), [*keys, *reset_keys, *order], rows)
    levels = {"": keys, **({reset_suffix: [*keys, *reset_keys]} if reset_keys else {})}
    out, results = done.join(F.broadcast(_carries(done, levels, list(measures))), _PART), []
    out = bounded(out, done.count() if rows is None else rows, _PART, *keys)
    for tag, level in levels.items():
        w = Window.partitionBy(_PART, *level).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({f"__r_{m}{tag}": F.sum(m).over(w) for m in measures})
        goes_on = _key(level).eqNullSafe(_key(level, "__first"))
        for m in measures:
            local, carry = F.col(f"__r_{m}{tag}"), F.when(goes_on, F.col(f"__c_{m}{tag}"))
            results.append(F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(local + carry).alias(m.removeprefix("__m_") + tag))
    return out.select(*df.columns, *results)


def _range_running(df: DataFrame, keys: list[str], order: Sequence[Column | str], sums: dict[str, Column], count_name: str | None) -> DataFrame:
    places = {f"__o{i}": c for i, c in enumerate(_cols(order))}
    x = df.withColumns(places)
    by = [*keys, *places]
    totals = x.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.count(F.lit(1)).alias("__n"))
    names = [*sums, *([count_name] if count_name else [])]
    run = keyed_running(totals.withColumnsRenamed({n: f"__t_{n}" for n in sums}), keys, list(places),
                        {**{n: F.col(f"__t_{n}") for n in sums}, **({count_name: F.col("__n")} if count_name else {})})
    run = run.select(*[F.col(c).alias(f"__j{i}") for i, c in enumerate(by)], *names)
    same = [F.col(c).eqNullSafe(F.col(f"__j{i}")) for i, c in enumerate(by)]
    return x.join(run, same).select(*df.columns, *names)


def lagged(df: DataFrame, keys: Sequence[str], idx: str, lags: dict[str, tuple[str, int]],
           block: int = 1024, rows: int = 0) -> DataFrame:
    """``lag(col, s)`` per key over the 1-based contiguous index ``idx``, without a per-key window.

    Rows are cut into blocks of ``block`` consecutive indices per key; the last
    ``max(s)`` rows of every block are also emitted into the next block as a
    halo (one ``explode``, so the input plan is evaluated once), and one
    window per (key, block) - at most ``block + max(s)`` rows - sees every
    predecessor it needs. One shuffle, bounded tasks, hot keys spread over as
    many blocks as they have rows / ``block``. ``rows``, if known, sets the
    number of tasks where the session's would make them too large.
    """
    keys = list(keys)
    reach = max(s for _, s in lags.values())
    size = max(block, reach)
    i = F.col(idx)
    blk = F.floor((i - 1) / size)
    own = F.struct(blk.alias("b"), F.lit(False).alias("h"))
    copy = F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))
    places = F.when(((i - 1) % size) >= size - reach, F.array(own, copy)).otherwise(F.array(own))
    u = df.withColumn("__p", F.explode(places)).withColumn("__blk", F.col("__p.b")) \
        .withColumn("__halo", F.col("__p.h")).drop("__p")
    u = bounded(u, rows, *keys, "__blk")
    w = Window.partitionBy(*keys, "__blk").orderBy(idx)
    u = u.withColumns({name: F.lag(col, s).over(w) for name, (col, s) in lags.items()})
    return u.where(~F.col("__halo")).drop("__blk", "__halo")


def range_numbered(df: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """``row_number() OVER (ORDER BY order)`` by one range-partitioned sort, whatever the keys look like.

    The totals before each part (one row a part) are added to the places inside it.
    """
    done = ordered_parts(df, order)
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = done.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n")) \
        .select(_PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return done.join(F.broadcast(offsets), _PART) \
        .withColumn(name, F.col("__before") + F.col(_AT) + 1).drop(_PART, _AT, "__before")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, take: Sequence[str], tie: Sequence[str] = (),
          inclusive: bool = False) -> DataFrame:
    """``left`` with the columns ``take`` of the last ``right`` row of the same keys before ``at`` (or at it, if ``inclusive``).

    Both sides are put in one order - keys, ``at``, lookups before or behind the rows of
    the same moment, then ``tie`` - by one range-partitioned sort; each lookup reads the
    last value carried to it, from its own part or, by one carry a part, from those before.
    No key is one task. Of several rows of a moment the last by ``tie`` counts. Rows whose
    key or moment is null find nothing; lookups without an earlier row get nulls.
    """
    keys, take = list(keys), list(take)
    key = F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keys])
    known = F.lit(True)
    for c in (*keys, at):
        known = known & F.col(c).isNotNull()
    shared = [*[F.col(k) for k in keys], F.col(at).alias("__time")]
    ties = [f"__tie{i}" for i in range(len(tie))]
    asks = left.select(*shared, F.lit(1 if inclusive else 0).alias("__side"), F.struct(*left.columns).alias("__left"))
    rows = right.where(known).select(*shared, F.lit(0 if inclusive else 1).alias("__side"), *[F.col(t).alias(n) for t, n in zip(tie, ties, strict=True)],
                                     F.struct(*take).alias("__row"))
    done = ordered_parts(asks.unionByName(rows, allowMissingColumns=True), [*keys, "__time", "__side", *ties])
    ends = done.groupBy(_PART).agg(F.min_by(key, _AT).alias("first"), F.max_by(key, _AT).alias("last"))
    latest = F.max_by(F.when(key.eqNullSafe(F.col("last")), F.col("__row")), F.when(F.col("__row").isNotNull() & key.eqNullSafe(F.col("last")), F.col(_AT)))
    tail = done.join(F.broadcast(ends), _PART).groupBy(_PART, "first", "last").agg(latest.alias("row"))
    so_far = Window.partitionBy("last").orderBy(_PART)
    before = Window.orderBy(_PART)  # one row a part
    tail = tail.select(_PART, "first", "last", F.last("row", ignorenulls=True).over(so_far).alias("row"))
    carry = tail.select(_PART, "first", F.when(F.lag("last").over(before).eqNullSafe(F.col("first")), F.lag("row").over(before)).alias("__carry"))
    local = F.last("__row", ignorenulls=True).over(Window.partitionBy(_PART, *keys).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0))
    out = bounded(done.join(F.broadcast(carry), _PART), done.count(), _PART, *keys).withColumn("__found", local).where("__left IS NOT NULL")
    found = F.coalesce("__found", F.when(key.eqNullSafe(F.col("first")), F.col("__carry")))
    return out.select("__left.*", *[found[c].alias(c) for c in take])
