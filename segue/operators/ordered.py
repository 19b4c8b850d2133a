"""Order-dependent work without one task per key or per table.

A key (a track) or the whole table may be far too large for one task.  The
helpers here cut an ordered sequence into blocks, solve the blocks in parallel
and stitch the results with small per-block totals.  All are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue import lineage

SALTS = 16
BUCKETS = 128


def attach(rows: DataFrame, per_key: DataFrame, key: str, spread: str, salts: int = SALTS,
           how: str = "inner") -> DataFrame:
    """Join per-key values to many rows per key.

    The rows of a key are spread over ``salts`` join keys by the integer column
    ``spread``; ``per_key`` (one row per key) is repeated as often.
    """
    salted = per_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (rows.withColumn("salt", F.pmod(F.col(spread), F.lit(salts)).cast("int"))
            .join(salted, [key, "salt"], how).drop("salt"))


def dense_index(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str) -> DataFrame:
    """Position 0, 1, 2, ... of every row inside its key.

    ``block`` must rise with ``order``.  Rows are numbered inside a block; the
    counts of the blocks before are added from a table of one row per block.
    """
    keys = list(keys)
    blocked = rows.withColumn("block", block)
    sizes = blocked.groupBy(*keys, "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "block").orderBy(*order)
    return (blocked.withColumn("inner", F.row_number().over(inside) - 1)
            .join(offsets, [*keys, "block"])
            .withColumn(name, (F.col("inner") + F.col("offset")).cast("long"))
            .drop("block", "inner", "offset"))


def range_index(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Position 0, 1, 2, ... inside its key for values that no block number can be computed from (texts).

    Rows are dealt to ranges of (key, order) by sampling, numbered inside their range and
    shifted by the sizes of earlier ranges.  The ranges are stored once, so that both
    steps see the same ones; no range depends on how the values begin.
    """
    placed = lineage.cut(rows.repartitionByRange(*keys, *order).withColumn("range", F.spark_partition_id()))
    return dense_index(placed, keys, order, F.col("range"), name).drop("range")


def blockwise(rows: DataFrame, index: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Repeat rows at block edges so that local windows can run per (key, block).

    Adds ``block`` and ``own`` (false for the repeated rows, to be dropped after
    the window).  Windows may look ``before`` rows back and ``after`` rows ahead.
    """
    at = F.floor(F.col(index) / size)
    inside = F.pmod(F.col(index), F.lit(size))
    blocks = [F.struct(at.alias("block"), F.lit(True).alias("own"))]
    if after:
        blocks.append(F.when((inside < after) & (at > 0), F.struct((at - 1).alias("block"), F.lit(False).alias("own"))))
    if before:
        blocks.append(F.when(inside >= size - before, F.struct((at + 1).alias("block"), F.lit(False).alias("own"))))
    return (rows.withColumn("cell", F.explode(F.array_compact(F.array(*blocks))))
            .select("*", "cell.block", "cell.own").drop("cell"))


def running_sum(rows: DataFrame, keys: Sequence[str], index: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Sum of ``value`` up to and including each row of its key, in ``index`` order.

    Rows are summed inside blocks; the totals of earlier blocks are added.
    """
    keys = list(keys)
    blocked = rows.withColumn("block", F.floor(F.col(index) / block))
    totals = blocked.groupBy(*keys, "block").agg(F.sum(value).alias("total"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "block", F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("offset"))
    inside = Window.partitionBy(*keys, "block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return (blocked.withColumn("partial", F.sum(value).over(inside)).join(offsets, [*keys, "block"])
            .withColumn(name, F.col("partial") + F.col("offset")).drop("block", "partial", "offset"))


def value_bucket(value: str, bounds: str = "bounds") -> Column:
    """Order-preserving bucket of a value: how many of the bounds lie below it."""
    return F.size(F.filter(bounds, lambda b: b < F.col(value))).cast("int")


def with_bounds(values: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Attach ``bounds``: approximate quantiles of the key's values, one array a key.

    A sketch of the values sets the cuts, so a bucket holds about the same number of
    rows whatever the values' range; being approximate only shifts the cuts, since
    results are stitched from exact totals.  ``keys`` must name a small set of groups.
    """
    keys = list(keys)
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    sketch = F.percentile_approx(value, shares, F.lit(10 * buckets))
    if not keys:
        return values.withColumn("bounds", values.agg(sketch).scalar())
    return values.join(values.groupBy(*keys).agg(sketch.alias("bounds")), keys)


def running_totals(rows: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str],
                   buckets: int = BUCKETS) -> DataFrame:
    """Per distinct value: the sums at that value and over all smaller values of the key.

    Rows are first added up per distinct value, so repeats of one value cost
    nothing.  ``keys`` must name a small set of groups (factors, genres).
    """
    keys = list(keys)
    distinct = rows.groupBy(*keys, value).agg(*[F.sum(s).alias(s) for s in sums])
    placed = with_bounds(distinct, keys, value, buckets).withColumn("bucket", value_bucket(value)).drop("bounds")
    totals = placed.groupBy(*keys, "bucket").agg(*[F.sum(s).alias(s) for s in sums])
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "bucket", *[
        F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"offset_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, [*keys, "bucket"]).select(
        *keys, value, *sums,
        *[(F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"offset_{s}")).alias(f"below_{s}") for s in sums])


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation of unbounded groups.

    Needs only running counts of distinct values; no group is ever held whole.
    """
    keys = list(keys)
    known = rows.where(F.col(value).isNotNull()).select(*keys, value, F.lit(1).cast("long").alias("n"))
    counts = running_totals(known, keys, value, ["n"])
    if keys:
        placed = counts.join(known.groupBy(*keys).agg(F.count("*").alias("size")), keys)
    else:
        placed = counts.withColumn("size", known.agg(F.count("*")).scalar())
    first, last = F.col("below_n"), F.col("below_n") + F.col("n") - 1
    columns, parts = [], []
    for name, share in points.items():
        position = (F.col("size") - 1) * F.lit(float(share))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            parts.append(F.max(F.when((first <= rank) & (rank <= last), F.col(value))).alias(f"{name}_{side}"))
        weight = position - F.floor(position)
        columns.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * weight).alias(name))
    return placed.groupBy(*keys, "size").agg(*parts).select(*keys, *columns)


SKETCH = 1000   # rank error of a sketch: one part in so many


def group_quantiles(rows: DataFrame, key: str, points: dict[str, dict[str, float]], spread: str) -> DataFrame:
    """Exact quantiles with linear interpolation of very many groups, each of any size: one row per key.

    ``points``: column -> {name of a result: share}.  A mergeable sketch brackets each
    quantile; a second pass counts what lies below the bracket and how often each value
    inside it occurs, both as partial sums.  Only the few values inside a bracket are
    ever ordered, never a group.  A group without values gets NULL.  Rows of a key are
    spread over join keys by the integer column ``spread``.  ``rows`` are read three times, so derived
    ones should be stored before; brackets and result are stored, one row per key.
    """
    asked = [(column, name, share) for column, names in points.items() for name, share in names.items()]
    reach = 4.0 / SKETCH
    used = rows.select(key, spread, *[F.col(v).cast("double").alias(v) for v in points])
    ends = {v: F.array(*[F.lit(x) for s in names.values() for x in (max(s - reach, 0.0), min(s + reach, 1.0))]) for v, names in points.items()}
    sketches = used.groupBy(key).agg(*[F.percentile_approx(v, e, F.lit(SKETCH)).alias(f"sketch_{v}") for v, e in ends.items()])
    places = {name: i for names in points.values() for i, name in enumerate(names)}
    brackets = lineage.stored(sketches.select(key, *[F.get(f"sketch_{v}", F.lit(2 * places[name] + side)).alias(f"{name}_{end}")
                                      for v, name, _ in asked for side, end in enumerate(("from", "to"))]))
    placed = attach(used, brackets, key, spread)
    low, high = (lambda name: F.col(f"{name}_from")), (lambda name: F.col(f"{name}_to"))
    counts = placed.groupBy(key).agg(*[F.count(v).alias(f"{v}_size") for v in points], *[x for v, name, _ in asked for x in (
        F.count_if(F.col(v) < low(name)).alias(f"{name}_below"), F.max(F.when(F.col(v) < low(name), F.col(v))).alias(f"{name}_under"),
        F.min(F.when(F.col(v) > high(name), F.col(v))).alias(f"{name}_over"))])
    facts = counts.select(key, F.explode(F.array(*[F.struct(
        F.lit(i).alias("q"), F.lit(float(share)).alias("share"), F.col(f"{v}_size").alias("size"), F.col(f"{name}_below").alias("below"),
        F.col(f"{name}_under").alias("under"), F.col(f"{name}_over").alias("over")) for i, (v, name, share) in enumerate(asked)])).alias("f")).select(key, "f.*")
    hits = F.array_compact(F.array(*[F.when((F.col(v) >= low(name)) & (F.col(v) <= high(name)), F.struct(F.lit(i).alias("q"), F.col(v).alias("x")))
                                     for i, (v, name, _) in enumerate(asked)]))
    inside = placed.select(key, F.explode(hits).alias("hit")).groupBy(key, "hit.q", "hit.x").agg(F.count("*").alias("times"))
    in_order = Window.partitionBy(key, "q").orderBy("x")
    ranked = inside.withColumn("until", F.sum("times").over(in_order)).join(facts, [key, "q"])
    position = (F.col("size") - 1) * F.col("share")
    first, last = F.col("below") + F.col("until") - F.col("times"), F.col("below") + F.col("until") - 1

    def at(rank: Column, name: str) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col("x"))).alias(name)

    found = ranked.groupBy(key, "q", "share", "size", "below", "under", "over").agg(
        F.max("until").alias("inside"), at(F.floor(position), "left"), at(F.ceil(position), "right"))

    def value(column: str, rank: Column) -> Column:
        before, behind = rank == F.col("below") - 1, rank == F.col("below") + F.col("inside")
        return F.coalesce(F.col(column), F.when(before, F.col("under")), F.when(behind, F.col("over")), F.raise_error(F.lit("quantile outside its bracket")))

    weight = position - F.floor(position)
    both = found.select(key, "q", ((1.0 - weight) * value("left", F.floor(position)) + weight * value("right", F.ceil(position))).alias("v"))
    wide = both.groupBy(key).agg(*[F.max(F.when(F.col("q") == i, F.col("v"))).alias(name) for i, (_, name, _) in enumerate(asked)])
    return lineage.stored(brackets.select(key).join(wide, key, "left"))
