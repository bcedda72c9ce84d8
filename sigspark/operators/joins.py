"""Interval joins and content matching."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import lookup_join


def interval_overlap(a: DataFrame, b: DataFrame, keys: list[str], a_bounds: tuple[str, str], b_bounds: tuple[str, str],
                     cell: float) -> DataFrame:
    """Pairs of half-open numeric intervals [lo, hi) of one key that overlap.

    Both sides are laid on a grid of ``cell`` width and joined on (keys, cell), so a key with many intervals is spread
    over its cells and far apart intervals never meet. A pair is emitted only in the first cell both share. Choose a
    cell near the typical interval length.
    """
    (alo, ahi), (blo, bhi) = a_bounds, b_bounds

    def cells(lo: str, hi: str) -> Column:
        last = F.greatest(F.ceil(F.col(hi) / cell) - 1, F.floor(F.col(lo) / cell))
        return F.explode(F.sequence(F.floor(F.col(lo) / cell), last))

    left, right = a.withColumn("_cell", cells(alo, ahi)), b.withColumn("_cell", cells(blo, bhi))
    start = F.greatest(F.col(alo), F.col(blo))
    return (left.join(right, [*keys, "_cell"])
            .where((start < F.least(F.col(ahi), F.col(bhi))) & (F.floor(start / cell) == F.col("_cell"))).drop("_cell"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, bounds: tuple[str, str], cell: float) -> DataFrame:
    """Points with every interval [lo, hi) of their key that contains them."""
    lo, hi = bounds
    last = F.greatest(F.ceil(F.col(hi) / cell) - 1, F.floor(F.col(lo) / cell))
    laid = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), last)))
    placed = points.withColumn("_cell", F.floor(F.col(at) / cell))
    return placed.join(laid, [*keys, "_cell"]).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_cell")


def eav_pivot(evidence: DataFrame, fields: list[str], prefix: str = "") -> DataFrame:
    """Entity-attribute-value rows to one row per entity with a column per named field."""
    wanted = evidence.where(F.col("field").isin([prefix + f for f in fields]))
    picks = [F.first(F.when(F.col("field") == prefix + f, F.col("value")), ignorenulls=True).alias(f) for f in fields]
    return wanted.groupBy("entity_id").agg(*picks)


def content_groups(items: DataFrame, digest: str, name: str) -> DataFrame:
    """(digest, canonical, copies): the first name in sorted order speaks for all copies of a content."""
    return items.groupBy(digest).agg(F.min(name).alias("canonical"), F.count("*").alias("copies"))


def with_canonical(items: DataFrame, digest: str, name: str) -> DataFrame:
    """Every item with the canonical name of its content. Contents copied very often are spread over several tasks."""
    table = content_groups(items, digest, name).withColumn("_w", F.col("copies"))
    return lookup_join(items, table, [digest], "_w")


def exact_copies(subjects: DataFrame, objects: DataFrame, on: list[str], subject: str, object_: str, method: str) -> DataFrame:
    """Lineage rows ``exact_copy_of``, or ``unmatched`` with a NULL object. One object is named per content: the first."""
    canon = objects.groupBy(*on).agg(F.min(object_).alias("object"))
    return (subjects.select(F.col(subject).alias("subject"), *on).join(canon, on, "left")
            .select("subject", F.when(F.col("object").isNull(), "unmatched").otherwise("exact_copy_of").alias("relation"),
                    "object", F.lit(method).alias("method"), F.lit("VERIFIED").alias("status")))


def paired_rows(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Two score sets on identical rows; raises if a row is missing on either side."""
    unmatched = a.select(row_id).join(b.select(row_id), row_id, "left_anti").limit(1).count() \
        + b.select(row_id).join(a.select(row_id), row_id, "left_anti").limit(1).count()
    if unmatched:
        raise ValueError("paired comparison needs identical rows")
    return a.join(b, row_id)


def replicate_rows(df: DataFrame, n: Column, index: str = "replica") -> DataFrame:
    return df.where(n > 0).withColumn(index, F.explode(F.sequence(F.lit(0), n - 1)))
