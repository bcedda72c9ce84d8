"""Ordered scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. Here the order column is first cut into
ranges of bounded size, so the unit of work is (key, range). What a window needs from earlier ranges is then added:

* bounded look-back (lag, K-of-N): the last few rows of the earlier ranges are copied in front, used, and dropped;
* running sums, counts, maxima: each (key, range) is reduced to one row, the reductions are scanned (at most one row
  per range and key) and the carried value is joined back on (key, range), the partitioning the window already has.

Inputs in which no key holds more than ``target_rows`` get one range and the plan is an ordinary window. NULL keys form one
key, whatever the size.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage

TARGET_ROWS = 2_000_000
SAMPLES = 20                                        # sampled rows per range
COARSE = 1_000                                      # cut points that are constants of a plan, at most
SHARED_CUTS = 1 << 18                               # cut points of a table that is broadcast, at most
RANGE = "_range"


def range_rows(df: DataFrame, target_rows: int | None) -> int:
    """Rows of one range: the argument, else the session's ``spark.sigspark.rangeRows``, else TARGET_ROWS."""
    return target_rows or int(df.sparkSession.conf.get("spark.sigspark.rangeRows", str(TARGET_ROWS)))


def _sampled(df: DataFrame, order: list[str], rows: int, n_rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` by hash, as distinct order tuples and their number ``_n``."""
    every = max(1, n_rows // rows)
    sample = df.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0) if every > 1 else df
    return sample.groupBy(*order).agg(F.count("*").alias("_n"))


def _cut_points(df: DataFrame, order: list[str], n: int, n_rows: int) -> list:
    """At most n - 1 order tuples that cut the rows into nearly equal parts, from a hash sample of SAMPLES rows per range.

    The tuples themselves are cut points, so any type that Spark orders will do, strings with a long common beginning too,
    and a heavy value of one column is cut by the next. Only the sample reaches the driver; if it holds more tuples than
    meant, a random part of them. Where the cuts lie changes the work per task, never a result.
    """
    some = _sampled(df, order, SAMPLES * n, n_rows).orderBy(F.xxhash64(*order, F.lit("cut"))).limit(2 * SAMPLES * n)
    distinct = some.orderBy(*order).collect()
    total, seen, place, cuts = sum(r["_n"] for r in distinct), 0, 1, []
    for r in distinct:
        while place < n and seen * n >= place * total:          # a tuple heavier than a range is a cut point once
            if not cuts or cuts[-1] != tuple(r)[:-1]:
                cuts.append(tuple(r)[:-1])
            place += 1
        seen += r["_n"]
    return cuts


def _fine_cuts(df: DataFrame, order: list[str], coarse: str, parts: int, n: int, n_rows: int) -> DataFrame:
    """(coarse, _cuts): at most ``parts`` - 1 cut points inside each coarse range, as a table made by tasks. A task holds the
    sample of one coarse range, SAMPLES tuples for each of its parts."""
    sample = _sampled(df, [*order, coarse], SAMPLES * n, n_rows)
    before = Window.partitionBy(coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (sample.withColumns({"_seen": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(coarse))})
              .withColumn("_place", F.floor(F.col("_seen") * parts / F.col("_all"))))
    first = placed.where(F.floor((F.col("_seen") + F.col("_n")) * parts / F.col("_all")) > F.col("_place")).where("_seen > 0")
    return first.groupBy(coarse).agg(F.array_sort(F.collect_list(_tuple(order))).alias("_cuts"))


def _tuple(order: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(order)])


def _place(points: Column, size: Column, steps: int, own: Column) -> Column:
    """How many of the sorted ``points`` are not above ``own``, by halving."""
    start = F.struct(F.lit(0).alias("lo"), size.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        right = F.get(points, mid) <= own
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]


def with_ranges(df: DataFrame, order: list[str], target_rows: int | None = None, n_rows: int | None = None
                ) -> tuple[DataFrame, int]:
    """Add ``_range``: an order-preserving bucket of about ``target_rows`` rows. Returns (df, number of ranges).

    A range begins at a cut point and holds every row up to the next one; rows with equal order columns share a range.
    Nulls come first, as Spark sorts them. Up to COARSE cut points are constants of the plan; where more are needed, the finer
    ones are a table (one row per coarse range) that is made by tasks and joined, broadcast while it has at most SHARED_CUTS
    points. So the driver sees at most 2 * SAMPLES * COARSE sampled tuples, whatever the input.
    """
    target_rows = range_rows(df, target_rows)
    if n_rows is None:
        n_rows = df.count()
    n = math.ceil(n_rows / target_rows)
    cuts = _cut_points(df, order, min(n, COARSE), n_rows) if n > 1 else []
    if not cuts:
        return df.withColumn(RANGE, F.lit(0)), 1
    kinds = [df.schema[c].dataType for c in order]
    constant = lambda v, t: F.lit(v.isoformat()).cast(t) if isinstance(t, T.TimestampNTZType) and v is not None else F.lit(v).cast(t)
    points = F.array(*[F.struct(*[constant(v, t).alias(f"c{k}") for k, (v, t) in enumerate(zip(point, kinds))]) for point in cuts])     # folded to one constant
    found = df.withColumn(RANGE, _place(points, F.lit(len(cuts)), len(cuts).bit_length(), _tuple(order)))
    if n <= COARSE:
        return found, len(cuts) + 1
    parts = math.ceil(n / (len(cuts) + 1))
    fine = cut_lineage(_fine_cuts(found, order, RANGE, parts, n, n_rows)).withColumnRenamed(RANGE, "_coarse")
    both = found.join(F.broadcast(fine) if n <= SHARED_CUTS else fine, F.col(RANGE) == F.col("_coarse"), "left")
    inner = _place(F.col("_cuts"), F.coalesce(F.size("_cuts"), F.lit(0)), parts.bit_length(), _tuple(order))
    return both.withColumn(RANGE, F.col(RANGE) * parts + F.when(F.col("_cuts").isNull(), 0).otherwise(inner)).drop("_coarse", "_cuts"), (len(cuts) + 1) * parts


def null_safe(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same names in which null equals null; the left side's columns stay."""
    other = table.withColumnsRenamed({c: f"_on_{c}" for c in on})
    if not on:
        return rows.join(F.broadcast(other), how=how)              # one row
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return rows.join(other, match, how).drop(*[f"_on_{c}" for c in on])


@dataclass(frozen=True)
class OrderedScan:
    """Rows of ``keys`` in ``order``; build with :func:`ordered`."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    ranges: int

    @property
    def local(self) -> list[str]:
        return [*self.keys, RANGE]

    def _window(self):
        return Window.partitionBy(*self.local).orderBy(*[F.col(c) for c in self.order])

    def with_columns(self, columns: dict[str, Column]) -> "OrderedScan":
        return replace(self, rows=self.rows.withColumns(columns))

    def lookback(self, columns: dict[str, "callable"], back: int) -> "OrderedScan":
        """Columns computed by ``f(window)`` over frames that reach at most ``back`` rows behind."""
        if self.ranges == 1:
            return self.with_columns({name: f(self._window()) for name, f in columns.items()})
        w_desc = Window.partitionBy(*self.local).orderBy(*[F.col(c).desc() for c in self.order])
        tails = (self.rows.withColumn("_from_end", F.row_number().over(w_desc))
                 .where(F.col("_from_end") <= back).drop("_from_end"))
        present = self.rows.select(*self.local).distinct()
        per_key = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(RANGE)
        later = present.select(*self.local, F.array(*[F.lead(RANGE, k).over(per_key) for k in range(1, back + 1)]).alias("_next"))
        hops = later.select(*self.local, F.explode("_next").alias("_to")).where(F.col("_to").isNotNull())
        ghosts = (null_safe(tails, hops, self.local).withColumn(RANGE, F.col("_to")).drop("_to")
                  .withColumn("_ghost", F.lit(True)))
        both = self.rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts)
        out = both.withColumns({name: f(self._window()) for name, f in columns.items()})
        return replace(self, rows=out.where(~F.col("_ghost")).drop("_ghost"))

    def lag(self, columns: dict[str, tuple[str, int]]) -> "OrderedScan":
        """new name -> (column, rows back)."""
        depth = max(k for _, k in columns.values())
        return self.lookback({new: (lambda w, c=c, k=k: F.lag(c, k).over(w)) for new, (c, k) in columns.items()}, depth)

    def running(self, columns: dict[str, tuple["callable", Column]], inclusive: bool = True) -> "OrderedScan":
        """new name -> (aggregate, expression): F.sum, F.max, F.min from the first row of the key up to this row
        (or the row before). The value before the first row is NULL."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if self.ranges == 1:
            return self.with_columns({new: agg(expr).over(frame) for new, (agg, expr) in columns.items()})
        totals = self.rows.groupBy(*self.local).agg(*[agg(expr).alias(f"_t_{new}") for new, (agg, expr) in columns.items()])
        before = (Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(RANGE)
                  .rowsBetween(Window.unboundedPreceding, -1))
        carried = totals.select(*self.local, *[agg(f"_t_{new}").over(before).alias(f"_c_{new}")
                                               for new, (agg, _) in columns.items()])
        combine = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.max: lambda a, b: F.greatest(a, b),
                   F.min: lambda a, b: F.least(a, b)}
        out = self.rows.withColumns({f"_l_{new}": agg(expr).over(frame) for new, (agg, expr) in columns.items()})
        out = null_safe(out, carried, self.local, "left")
        out = out.withColumns({new: combine[agg](F.col(f"_c_{new}"), F.col(f"_l_{new}"))
                               for new, (agg, _) in columns.items()})
        return replace(self, rows=out.drop(*[f"_{p}_{new}" for new in columns for p in "lc"]))

    def row_number(self, name: str = "rn") -> "OrderedScan":
        return self.running({name: (F.sum, F.lit(1).cast("long"))})

    def islands(self, name: str, starts: Column) -> "OrderedScan":
        """Number the runs of each key; ``starts`` is true on the first row of a run."""
        return self.running({name: (F.sum, F.when(starts, 1).otherwise(0).cast("long"))})

    def frame(self) -> DataFrame:
        return self.rows.drop(RANGE)


def row_bound(source: DataFrame, reduced: DataFrame, target_rows: int | None) -> int:
    """Rows of a reduced table (distinct values, counts), or the cheaper count of its source if that is small already."""
    n = source.count()
    return n if n <= range_rows(source, target_rows) else reduced.count()


def kept_counts(source: DataFrame, reduced: DataFrame, target_rows: int | None) -> tuple[DataFrame, int]:
    """The reduced table and its ``row_bound``. A source larger than a range is reduced once and the result kept, since a scan in
    ranges reads it again for its sizes, its cut points and the values carried over."""
    n = source.count()
    if n <= range_rows(source, target_rows):
        return reduced, n
    kept = cut_lineage(reduced)
    return kept, kept.count()


def ordered(df: DataFrame, keys: list[str], order: list[str], target_rows: int | None = None,
            n_rows: int | None = None) -> OrderedScan:
    """Start an ordered scan. ``order`` must be total within a key, or results depend on ties.

    Where no key holds more than a range's rows, a key is one unit of work already and the scan is a plain window: one count
    per key is all that is read before it. Else the rows are cut into ranges.
    """
    target_rows = range_rows(df, target_rows)
    if keys and (n_rows is None or n_rows > target_rows):
        found = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
        if (found[1] or 0) <= target_rows:
            return OrderedScan(df.withColumn(RANGE, F.lit(0)), list(keys), list(order), 1)
        n_rows = found[0]
    rows, n = with_ranges(df, order, target_rows, n_rows)
    return OrderedScan(rows, list(keys), list(order), n)


def _hashable(rows: DataFrame) -> list[Column]:
    """All columns in a form that a hash takes: those that hold a map as JSON, variants as text."""
    def holds(kind: T.DataType, *wanted: type) -> bool:
        inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.keyType, kind.valueType] if isinstance(kind, T.MapType) else []
        return isinstance(kind, wanted) or any(holds(k, *wanted) for k in inner)
    named = [(F.col(f"`{f.name.replace('`', '``')}`"), f.dataType) for f in rows.schema]
    return [F.to_json(F.struct(c.alias("v"))) if holds(t, T.MapType, T.VariantType) else c for c, t in named]


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner",
                salts: int = 64, share: int = 1000) -> DataFrame:
    """Join rows with a table that has one line per key and states in ``weight`` how many rows carry that key.

    Keys holding more than 1/``share`` of all rows are spread over ``salts`` tasks. By definition there are fewer than
    ``share`` such keys, which bounds the broadcast list. ``weight`` is dropped.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) * share > F.lit(total)).select(*on).withColumn("_hot", F.lit(True))
    salted_rows = (null_safe(rows, F.broadcast(hot), on, "left")
                   .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*_hashable(rows)), F.lit(salts)))
                               .otherwise(F.lit(0)).cast("int")).drop("_hot"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_table = (table.withColumn("_salt", F.explode(
        F.when(F.col(weight) * share > F.lit(total), every).otherwise(F.array(F.lit(0))))).drop(weight))
    return null_safe(salted_rows, salted_table, [*on, "_salt"], how).drop("_salt")
