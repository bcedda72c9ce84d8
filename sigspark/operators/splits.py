"""Leakage-safe splits with identities that never change meaning."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.publication import Publication
from .scan import lookup_join, ordered

NO_LABEL = "None"


def official(captures: DataFrame) -> DataFrame:
    """The release's own split; captures without one are left out (an empty name counts as none)."""
    return (captures.where(F.col("official_split").isNotNull() & (F.col("official_split") != ""))
            .select("capture_id", F.col("official_split").alias("partition")))


def group_labels(captures: DataFrame, label: str, group: str = "group_id") -> DataFrame:
    """(group, n, stratum): the sorted set of label values of a group. NULL means "not a detection class" and is kept
    as its own value; it is never read as False."""
    value = F.coalesce(F.col(label).cast("string"), F.lit(NO_LABEL))
    return captures.groupBy(group).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(value)).alias("stratum"))


def feasibility(captures: DataFrame, label: str, group: str = "group_id") -> DataFrame:
    """(stratum, n_groups); groups whose label is entirely NULL are skipped."""
    return (group_labels(captures, label, group).where(F.col("stratum") != F.array(F.lit(NO_LABEL)))
            .groupBy(F.array_join("stratum", "|").alias("stratum")).agg(F.count("*").alias("n_groups")))


# ------------------------------------------------------------------ balanced group k-fold
def _deal(classes: list[tuple[int, int]], k: int) -> list[tuple[int, int, list[int], list[int]]]:
    """Largest-first, least-loaded dealing of groups to k folds, by size class.

    classes: (size, how many groups) in descending size. Giving items of one size to the least-loaded fold (lowest
    fold on ties) visits the folds within one item of the minimum in a fixed cycle until the next fold is reached, so
    a class needs at most k + 1 segments however many groups it has. Returns (size, first position, cycle, loads).
    """
    load = [0] * k
    out = []
    for size, many in classes:
        at = 0
        while at < many:
            ranked = sorted(range(k), key=lambda f: (load[f], f))
            floor = (load[ranked[0]] + size, ranked[0])
            cycle = [f for f in ranked if (load[f], f) < floor]
            rest = ranked[len(cycle):]
            whole = many - at if not rest else None
            if rest:
                # rounds until the minimum passes the next fold: (load_min + r * size + size, min) > (load_next, next)
                gap = (load[rest[0]], rest[0])
                rounds = max(1, math.ceil((gap[0] - load[ranked[0]]) / size) - 1)
                while (load[ranked[0]] + rounds * size + size, ranked[0]) <= gap:
                    rounds += 1
                while rounds > 1 and (load[ranked[0]] + (rounds - 1) * size + size, ranked[0]) > gap:
                    rounds -= 1
                whole = min(many - at, rounds * len(cycle))
            out.append((size, at, cycle, list(load)))
            each, extra = divmod(whole, len(cycle))
            for i, f in enumerate(cycle):
                load[f] += size * (each + (1 if i < extra else 0))
            at += whole
    return out


def group_kfold(captures: DataFrame, k: int, label: str, group: str = "group_id", order: Column | None = None) -> DataFrame:
    """(group, stratum, n, fold): whole groups to folds, balancing the captures of every stratum.

    Only the histogram of group sizes reaches the driver: its length is bounded by the number of *distinct* sizes
    (at most sqrt(2 N) for N captures). Ties in size follow ``order``, default the group id itself.
    """
    groups = group_labels(captures, label, group).withColumn("stratum", F.array_join("stratum", "|"))
    groups = groups.withColumn("_tie", F.col(group) if order is None else order)
    histogram = groups.groupBy("stratum", "n").agg(F.count("*").alias("many")).collect()
    by_stratum: dict[str, list[tuple[int, int]]] = {}
    for row in histogram:
        by_stratum.setdefault(row["stratum"], []).append((row["n"], row["many"]))
    segments = [(stratum, size, at, cycle) for stratum, classes in by_stratum.items()
                for size, at, cycle, _ in _deal(sorted(classes, reverse=True), k)]
    plan = captures.sparkSession.createDataFrame(segments, "stratum string, n long, at long, cycle array<int>")
    per_class = plan.groupBy("stratum", "n").agg(F.array_sort(F.collect_list(F.struct("at", "cycle"))).alias("segments"))
    placed = ordered(groups, ["stratum", "n"], ["_tie", group]).row_number("rn").frame()
    chosen = F.element_at(F.filter("segments", lambda s: s["at"] <= F.col("rn") - 1), -1)
    step = F.col("rn") - 1 - chosen["at"]
    fold = F.element_at(chosen["cycle"], (step % F.size(chosen["cycle"]) + 1).cast("int"))
    return placed.join(per_class, ["stratum", "n"]).select(group, "stratum", "n", fold.alias("fold"))


def assign(captures: DataFrame, folds: DataFrame, group: str = "group_id", capture: str = "capture_id") -> DataFrame:
    """(capture, partition) from fold numbers of whole groups."""
    sized = folds.select(group, "fold", "n") if "n" in folds.columns else folds.select(group, "fold").withColumn("n", F.lit(1))
    return lookup_join(captures, sized, [group], "n").select(capture, F.concat(F.lit("fold"), F.col("fold")).alias("partition"))


def balanced_by_dataset(captures: DataFrame, k: int, group: str = "group_id") -> DataFrame:
    """Folds for dataset identification: the label is the dataset itself."""
    return group_kfold(captures.withColumn("_dataset", F.split("capture_id", "/")[0]), k, "_dataset", group)


def sorted_round_robin(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, partition): groups in sorted order dealt in turn to k folds."""
    distinct = ordered(df.select(group).distinct(), [], [group]).row_number("rn").frame()
    return distinct.select(group, F.concat(F.lit("fold"), (F.col("rn") - 1) % k).alias("partition"))


def stratified_kfold(df: DataFrame, key: str, strata: list[str], k: int, seed: int = 0) -> DataFrame:
    """Rows of every stratum dealt to k folds in a seeded hash order."""
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    return (ordered(hashed, strata, ["_h", key]).row_number("_rn").frame()
            .withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_h", "_rn"))


def leave_one_group_out(rows: DataFrame, group: str, label: str, min_groups: int = 2) -> DataFrame:
    """(fold, group, label): one fold per group of every class that has at least ``min_groups`` groups."""
    pairs = rows.select(label, group).distinct()
    enough = pairs.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= min_groups).select(label)
    return pairs.join(enough, label).select(F.concat(F.lit("without "), F.col(group)).alias("fold"), group, label)


def designed_folds(rows: DataFrame, folds: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows with a (fold, role) per designed hold-out. folds: name -> (train condition, test condition)."""
    tags = F.array(*[F.when(train, F.struct(F.lit(n).alias("fold"), F.lit("train").alias("role")))
                     .when(test, F.struct(F.lit(n).alias("fold"), F.lit("test").alias("role"))) for n, (train, test) in folds.items()])
    tagged = rows.withColumn("_f", F.explode(F.filter(tags, lambda t: t.isNotNull())))
    return tagged.select(*rows.columns, "_f.fold", "_f.role")


def day_receiver_folds(day: str = "day", rx: str = "rx") -> dict[str, tuple[Column, Column]]:
    """Designed hold-outs for days d1..d3 and receivers u1, u2: (train, test) conditions."""
    d, r = F.col(day), F.col(rx)
    return {"first day to second": (d == "d1", (d == "d2") & (r == "u2")),
            "first day to third": (d == "d1", (d == "d3") & (r == "u2")),
            "receiver to receiver": ((d == "d2") & (r == "u2"), (d == "d2") & (r == "u1"))}


def unseen_unit_folds(rows: DataFrame, unit: str, train: Column, test: Column) -> DataFrame:
    """(fold, role, ...): per held-out unit, training rows of the other units and test rows of that unit.

    A test row belongs to one fold. A training row belongs to every other fold; instead of writing it that many times
    the fold list stays a table and the pairing is made when a fold is fitted, see ``fold_role``.
    """
    tested = rows.where(test).select(unit).distinct()
    return tested.select(F.concat(F.lit("without "), F.col(unit)).alias("fold"), F.col(unit).alias("held_out"))


def fold_role(unit: str, held_out: str, train: Column, test: Column) -> Column:
    return F.when(test & (F.col(unit) == held_out), "test").when(train & (F.col(unit) != held_out), "train")


# ------------------------------------------------------------------ checks, identity, registry
def leakage_problems(captures: DataFrame, assignment: DataFrame, group: str = "group_id", capture: str = "capture_id") -> DataFrame:
    """(rule, entity_id, detail): groups in several partitions and assigned captures nobody knows."""
    placed = assignment.join(captures.select(capture, group), capture, "left")
    spans = (placed.where(F.col(group).isNotNull()).groupBy(group)
             .agg(F.array_sort(F.collect_set("partition")).alias("p")).where(F.size("p") > 1)
             .select(F.lit("group spans partitions").alias("rule"), F.col(group).cast("string").alias("entity_id"),
                     F.array_join("p", ",").alias("detail")))
    unknown = (placed.where(F.col(group).isNull())
               .select(F.lit("unknown capture").alias("rule"), F.col(capture).cast("string").alias("entity_id"), F.lit("").alias("detail")))
    return spans.unionByName(unknown)


DIGEST_STEP = 3            # hex digits per level: a node of the digest tree has at most 4096 children
LINES_PER_BLOCK = 100_000


def _lines(rows: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_list(rows)), "\n")


def block_digest(assignment: DataFrame, capture: str = "capture_id", lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """One row (captures, levels, assignment_sha256): a hash tree over the sorted ``capture<TAB>partition`` lines.

    Leaves are chosen by the hash of the capture id, so ids cannot skew them, and there are enough of them (a rule of
    the row count alone) that a leaf stays near ``lines_per_block`` lines; every node above has at most 4096 children.
    """
    n = assignment.count()
    levels = 1
    while n / lines_per_block > 16 ** (DIGEST_STEP * levels):
        levels += 1
    line = F.concat_ws("\t", F.col(capture).cast("string"), F.col("partition"))
    at = F.substring(F.sha2(F.col(capture).cast("string"), 256), 1, DIGEST_STEP * levels)
    nodes = (assignment.select(at.alias("at"), line.alias("line")).groupBy("at")
             .agg(F.sha2(_lines(F.col("line")), 256).alias("h"), F.count("*").alias("n")))
    for level in range(levels - 1, -1, -1):
        parent = F.substring("at", 1, DIGEST_STEP * level) if level else F.lit("")
        nodes = (nodes.groupBy(parent.alias("p")).agg(F.sha2(_lines(F.concat_ws("\t", "at", "h")), 256).alias("h"), F.sum("n").alias("n"))
                 .withColumnRenamed("p", "at"))
    return nodes.select(F.col("n").alias("captures"), F.lit(levels).alias("levels"), F.col("h").alias("assignment_sha256"))


REGISTRY = T.StructType([
    T.StructField("split_id", T.StringType(), False), T.StructField("kind", T.StringType()),
    T.StructField("strategy", T.StringType()), T.StructField("seed", T.IntegerType()),
    T.StructField("datasets", T.ArrayType(T.StringType())), T.StructField("captures", T.LongType()),
    T.StructField("assignment_sha256", T.StringType()),
    T.StructField("counts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))),
    T.StructField("group_leakage_checked", T.BooleanType()), T.StructField("notes", T.StringType()),
    T.StructField("created", T.StringType()), T.StructField("retired", T.StringType()), T.StructField("reason", T.StringType())])


class SplitRegistry:
    """Published split tables under one folder, each with its digest, counts and notes.

    An id is never reused: saving the same assignment again is a no-op, another assignment or a retired id is an error.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.published = spark, Publication(spark, folder)

    @staticmethod
    def _line(entry: dict) -> dict:
        return {"split_id": entry["id"], **entry["info"], "created": entry["created"], "retired": entry["retired"], "reason": entry["reason"]}

    def entries(self) -> DataFrame:
        lines = [self._line(e) for e in self.published.entries()]
        return self.spark.createDataFrame([tuple(e[f] for f in REGISTRY.fieldNames()) for e in lines], REGISTRY)

    def save(self, split_id: str, kind: str, strategy: str, captures: DataFrame, assignment: DataFrame, *,
             label: str = "label_uas_present", seed: int | None = None, notes: str | None = None, check_groups: bool = True) -> dict:
        if check_groups:
            problems = leakage_problems(captures, assignment).limit(5).collect()
            if problems:
                raise ValueError(f"{split_id}: " + "; ".join(f"{p['rule']} {p['entity_id']} {p['detail']}" for p in problems))
        digest = block_digest(assignment).first()
        known = self.published.entry(split_id)
        if known and not known["retired"]:
            if known["info"]["assignment_sha256"] == digest["assignment_sha256"]:
                return self._line(known)
            raise ValueError(f"{split_id} exists with a different assignment; retire it or use a new id")
        tally: dict[str, dict[str, int]] = {}
        for r in counts_by_partition_label(assignment.join(captures, "capture_id"), label).collect():              # partitions x label values
            tally.setdefault(r["partition"], {})[r["label"]] = r["n"]
        datasets = [r[0] for r in assignment.select(F.split("capture_id", "/")[0]).distinct().orderBy(1).collect()]
        info = {"kind": kind, "strategy": strategy, "seed": seed, "datasets": datasets, "captures": digest["captures"],
                "assignment_sha256": digest["assignment_sha256"], "counts": tally, "group_leakage_checked": check_groups, "notes": notes}
        return self._line(self.published.publish(split_id, {"assignment": assignment.select("capture_id", "partition")}, info))

    def retire(self, split_id: str, reason: str) -> None:
        self.published.retire(split_id, reason)

    def load(self, split_id: str) -> DataFrame:
        known, stored = self.published.entry(split_id), self.published.read(split_id, "assignment", verify=False)
        if block_digest(stored).first()["assignment_sha256"] != known["info"]["assignment_sha256"]:
            raise ValueError(f"{split_id}: assignment no longer matches the registry")
        return stored


def counts_by_partition_label(joined: DataFrame, label: str) -> DataFrame:
    return joined.groupBy("partition", F.coalesce(F.col(label).cast("string"), F.lit(NO_LABEL)).alias("label")).agg(F.count("*").alias("n"))


def default_plan(captures: DataFrame, groups: DataFrame, label: str = "label_uas_present") -> list[dict]:
    """The splits a dataset gets. Its own split is kept if it has one. Besides, when any group's independence is
    unknown everything is test; otherwise a group k-fold with k = min(5, fewest groups per label value), or, if a
    value has a single group, min(5, most groups) with a note."""
    plans = []
    if official(captures).limit(1).count():
        plans.append({"strategy": "official"})
    if groups.where(F.col("status") == "UNKNOWN").limit(1).count():
        return [*plans, {"strategy": "evaluation-only"}]
    sizes = [r["n_groups"] for r in feasibility(captures, label).collect()]       # one row per set of label values
    if not sizes:
        return plans
    if min(sizes) >= 2:
        return [*plans, {"strategy": "group-kfold", "k": min(5, min(sizes))}]
    return [*plans, {"strategy": "group-kfold", "k": min(5, max(sizes)), "note": "a label value has a single group"}]
