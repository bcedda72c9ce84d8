"""Catalog checks and the small steps every catalog builder is made of."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import has_drive_path
from ..schemas import INDEX_STATUSES

PROBLEM = ["rule", "entity_id", "detail"]
KEYS = {"artifacts": "artifact_id", "captures": "capture_id", "groups": "group_id"}


def problem(df: DataFrame, rule: str, entity: str | Column, detail: Column | None = None) -> DataFrame:
    e = F.col(entity) if isinstance(entity, str) else entity
    return df.select(F.lit(rule).alias("rule"), e.cast("string").alias("entity_id"),
                     (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def row_problems(df: DataFrame, entity: str, rules: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """Rules that need only the row itself, all in one pass: rule -> (condition under which it is broken, detail)."""
    marks = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(rule).alias("rule"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail")))
             for rule, (broken, detail) in rules.items()]
    found = df.select(F.col(entity).cast("string").alias("entity_id"), F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m"))
    return found.select("m.rule", "entity_id", "m.detail")


def duplicate_keys(df: DataFrame, key: str, rule: str) -> DataFrame:
    many = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return problem(many, rule, key, F.col("_n"))


def dangling(children: DataFrame, fk: str, parents: DataFrame, pk: str, entity: str, rule: str) -> DataFrame:
    """Children whose non-NULL reference names no parent.

    Keys meet by merge: a column of ids packs to a byte a row on disk, so by its estimate Spark would send all of them through
    the driver."""
    known = parents.select(F.col(pk).alias("_pk")).hint("merge")
    lost = children.where(F.col(fk).isNotNull()).select(entity, fk).join(known, F.col(fk) == F.col("_pk"), "left_anti")
    return problem(lost, rule, entity, F.col(fk))


def count_mismatch(parents: DataFrame, pk: str, declared: str, children: DataFrame, fk: str, rule: str) -> DataFrame:
    """Parents whose declared number of children differs from the number that points at them."""
    found = children.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_pk")).agg(F.count("*").alias("_n")).hint("merge")         # as in dangling
    j = parents.select(F.col(pk).alias("_pk"), F.col(declared).alias("_d")).join(found, "_pk", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    bad = j.where(~F.col("_d").eqNullSafe(F.col("_n")))
    return problem(bad, rule, "_pk", F.concat_ws(" vs ", F.col("_d").cast("string"), F.col("_n").cast("string")))


def index_problems(tables: dict[str, DataFrame], dataset_id: str) -> DataFrame:
    """All violations of keys, prefixes, paths, references, counts, containers and statuses as (rule, entity_id, detail)."""
    a, c, g = (tables[n] for n in ("artifacts", "captures", "groups"))

    def own(name: str) -> dict[str, tuple[Column, Column | None]]:
        key = F.col(KEYS[name])
        foreign = (~F.col("dataset_id").eqNullSafe(F.lit(dataset_id))) | (~F.startswith(key, F.lit(dataset_id + "/"))) | key.isNull()
        return {f"{name}: not under the dataset": (foreign, None), f"{name}: drive path": (has_drive_path(key), None)}

    def status(name: str, field: str) -> dict[str, tuple[Column, Column | None]]:
        return {f"{name}: unknown status": (~F.coalesce(F.col(field).isin(INDEX_STATUSES), F.lit(False)), F.col(field))}

    contained, wrong_count = F.col("stored_in").isNotNull(), "capture: n_artifacts does not match"
    relpath = F.col("storage_relpath")
    parts = [duplicate_keys(tables[name], key, f"{name}: duplicate {key}") for name, key in KEYS.items()]
    parts += [row_problems(a, "artifact_id", {**own("artifacts"), "artifacts.storage_relpath: drive path": (has_drive_path(relpath), relpath)}),
              row_problems(c, "capture_id", {**own("captures"), **status("captures", "label_status"), "capture points at unknown group": (F.col("group_id").isNull(), None),
                                             "stored_in without stored_index": (contained & F.col("stored_index").isNull(), None),
                                             wrong_count: (contained & ~F.col("n_artifacts").eqNullSafe(F.lit(0)), F.col("n_artifacts"))}),
              row_problems(g, "group_id", {**own("groups"), **status("groups", "status")}),
              row_problems(tables["lineage"], "subject", status("lineage", "status")), row_problems(tables["evidence"], "entity_id", status("evidence", "status")),
              dangling(a, "capture_id", c, "capture_id", "artifact_id", "artifact points at unknown capture"),
              dangling(c, "group_id", g, "group_id", "capture_id", "capture points at unknown group"),
              dangling(c, "stored_in", a, "artifact_id", "capture_id", "stored_in names no artifact"),
              count_mismatch(c.where(~contained), "capture_id", "n_artifacts", a, "capture_id", wrong_count),
              count_mismatch(g, "group_id", "n_captures", c, "group_id", "group: n_captures does not match")]
    return union_all(parts)


def assert_valid(tables: dict[str, DataFrame], dataset_id: str) -> None:
    found = index_problems(tables, dataset_id).limit(5).collect()
    if found:
        raise ValueError(f"{dataset_id}: " + "; ".join(f"{p['rule']} {p['entity_id']} {p['detail']}".strip() for p in found))


def groups_from(captures: DataFrame, kind: str | Column, basis: str | Column, status: str) -> DataFrame:
    """Group rows with their capture counts; kind and basis may depend on the group id."""
    def column(v: str | Column) -> Column:
        return F.lit(v) if isinstance(v, str) else v
    return (captures.groupBy("group_id", "dataset_id").agg(F.count("*").cast("int").alias("n_captures"))
            .select("group_id", "dataset_id", column(kind).alias("kind"), column(basis).alias("basis"), F.lit(status).alias("status"), "n_captures"))


def pair_completeness(segments: DataFrame, keys: list[str], band: str, bands: list[str]) -> DataFrame:
    """Segments that do not have each band exactly once: (rule, entity_id, detail)."""
    g = segments.groupBy(*keys).agg(F.array_sort(F.collect_set(band)).alias("b"), F.count("*").alias("n"))        # few bands
    e = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    want = F.array(*[F.lit(b) for b in sorted(bands)])
    return problem(g.where(F.col("b") != want), "incomplete pair", e, F.array_join("b", ",")).unionByName(
        problem(g.where(F.col("n") > F.size("b")), "duplicate band", e, F.col("n")))


def name_disagreement(rows: DataFrame, a: str, b: str, entity: str) -> DataFrame:
    return problem(rows.where(~F.col(a).eqNullSafe(F.col(b))), "folder and name disagree", entity, F.concat_ws(" vs ", F.col(a).cast("string"), F.col(b).cast("string")))


def published_counts(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Evidence rows: published against found counts, VERIFIED or CONFLICTING. expected (key, n), found (key, n)."""
    j = expected.select(F.col(key).cast("string").alias("_k"), F.col("n").alias("e")).join(found.select(F.col(key).cast("string").alias("_k"), F.col("n").alias("f")), "_k", "full_outer")
    same = F.col("e").eqNullSafe(F.col("f"))
    return j.select(F.col("_k").alias("entity_id"), F.lit("count").alias("field"),
                    F.concat_ws(" ", F.coalesce(F.col("f"), F.lit(0)).cast("string"), F.lit("found,"), F.coalesce(F.col("e"), F.lit(0)).cast("string"), F.lit("published")).alias("value"),
                    F.when(same, "VERIFIED").otherwise("CONFLICTING").alias("status"))
