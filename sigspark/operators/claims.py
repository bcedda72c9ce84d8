"""Graded claims: constraint checks, the pivoted matrix, and audits. Every check returns (rule, entity_id, detail)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CLAIM_KINDS, CLAIM_STATUSES, N_UNITS
from .catalog import problem, union_all
from .profiles import status_cube

ABSENT = ["UNKNOWN", "NOT_APPLICABLE"]


def _evidence_rules(status: Column, n: Column, unit: Column, source: Column) -> dict[str, Column]:
    absent = status.isin(ABSENT)
    return {"EMPIRICAL needs n and n_unit": (status == "EMPIRICAL") & n.isNull(),
            "n and n_unit go together": n.isNull() != unit.isNull(),
            "n must be positive": n < 1,
            "unknown n_unit": ~unit.isin(N_UNITS),
            "an absent status cannot carry n": absent & n.isNotNull(),
            "graded claim needs a source": ~absent & ~status.isin("UNGRADED", "CONFLICTING") & (F.coalesce(source, F.lit("")) == "")}


def claim_rules() -> dict[str, Column]:
    """Rule -> condition under which a claim violates it. Facts have text and kind, measured values value or varies."""
    status, conflict = F.col("status"), F.col("conflict")
    sides = F.coalesce(F.size(conflict), F.lit(0))
    sides = F.when(conflict.isNull(), 0).otherwise(sides)
    absent, measured = status.isin(ABSENT), F.col("section") == "signal"
    has_value, varies = F.col("value").isNotNull(), F.coalesce("varies", F.lit(False))
    text = F.col("text")
    rules = {"unknown status": ~F.coalesce(status.isin(CLAIM_STATUSES), F.lit(False)),
             "unknown kind": ~measured & ~F.coalesce(F.col("kind").isin(CLAIM_KINDS), F.lit(False)),
             **_evidence_rules(status, F.col("n"), F.col("n_unit"), F.col("source")),
             "CONFLICTING and only CONFLICTING has a conflict list": (status == "CONFLICTING") != (sides > 0),
             "a conflict needs at least two claims": sides == 1,
             "text is missing": ~measured & (F.coalesce(text, F.lit("")) == ""),
             "text must be one line without a bare bar": ~measured & (text.contains("\n") | F.regexp_replace(text, r"\\\|", "").contains("|")),
             "an absent value must be empty": measured & absent & (has_value | varies),
             "give a value or varies, not both and not neither": measured & ~absent & (varies == has_value)}
    return rules


def claim_problems(claims: DataFrame) -> DataFrame:
    """One pass over the claims: every broken rule is one row. Conflict sides obey the evidence rules too."""
    entity = F.concat_ws("/", "dataset_id", "section", "key")
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(rule)) for rule, c in claim_rules().items()]), lambda r: r.isNotNull())
    own = claims.select(entity.alias("entity_id"), F.explode(broken).alias("rule"), F.lit("").alias("detail"))
    sides = claims.where(F.size("conflict") > 0).select(entity.alias("entity_id"), F.explode("conflict").alias("s"))
    rules = _evidence_rules(F.col("s.status"), F.col("s.n"), F.col("s.n_unit"), F.col("s.source"))
    rules["a conflict side must be graded"] = F.col("s.status").isin(ABSENT + ["CONFLICTING", "UNGRADED"])
    side_broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(rule)) for rule, c in rules.items()]), lambda r: r.isNotNull())
    theirs = sides.select("entity_id", F.explode(side_broken).alias("rule"), F.col("s.claim").alias("detail"))
    return own.select("rule", "entity_id", "detail").unionByName(theirs.select("rule", "entity_id", "detail"))


def key_set_problems(left: DataFrame, right: DataFrame, key: str, missing: str, unknown: str) -> DataFrame:
    """Keys of ``left`` without a row in ``right`` (missing) and the reverse (unknown)."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return problem(l.join(r, key, "left_anti"), missing, key).unionByName(problem(r.join(l, key, "left_anti"), unknown, key))


def spec_problems(claims: DataFrame, policies: DataFrame, rows: DataFrame, columns: DataFrame, modality: str, supplements: DataFrame | None = None) -> DataFrame:
    """What would make the matrix of one modality wrong or incomplete."""
    rows, columns = rows.where(F.col("modality") == modality), columns.where(F.col("modality") == modality)
    facts = claims.where(F.col("section") == "facts")
    cards = claims.select("dataset_id", "modality").distinct()
    of_modality = cards.where(F.col("modality") == modality).select("dataset_id")
    cols = columns.select("dataset_id").distinct()
    pair = F.concat_ws("/", "dataset_id", "key")
    known = columns.join(cards, "dataset_id", "left_semi").select("dataset_id").distinct()

    def grid(which: DataFrame) -> DataFrame:
        # rows of a matrix spec: a short, hand-written list, so every dataset carries it as one array
        keys = which.agg(F.collect_set("key").alias("keys"))
        return known.join(F.broadcast(keys)).select("dataset_id", F.explode("keys").alias("key"))

    card_rows, policy_rows = rows.where(~F.col("policy")), rows.where("policy")
    shown = facts.join(known, "dataset_id", "left_semi").select("dataset_id", "key")
    with_policy = policies.select("dataset_id").distinct()
    parts = [problem(of_modality.join(cols, "dataset_id", "left_anti"), "card without a matrix column", "dataset_id"),
             problem(cols.join(cards, "dataset_id", "left_anti"), "column has no card", "dataset_id"),
             problem(cols.join(cards.where(F.col("modality") != modality), "dataset_id", "left_semi"), "column is a card of another modality", "dataset_id"),
             problem(grid(card_rows).join(shown, ["dataset_id", "key"], "left_anti"), "fact missing for a row", pair),
             problem(shown.join(card_rows.select("key"), "key", "left_anti"), "fact for no row of the matrix", pair)]
    needs_policy = known.join(F.broadcast(policy_rows.agg(F.count("*").alias("_p")))).where("_p > 0").select("dataset_id")
    own = policies.join(known, "dataset_id", "left_semi").select("dataset_id", "key")
    parts += [problem(needs_policy.join(with_policy, "dataset_id", "left_anti"), "no policy entry", "dataset_id"),
              problem(grid(policy_rows).join(with_policy, "dataset_id", "left_semi").join(own, ["dataset_id", "key"], "left_anti"), "policy row missing", pair),
              problem(own.join(policy_rows.select("key"), "key", "left_anti"), "policy for no row of the matrix", pair)]
    if supplements is not None:
        parts.append(problem(supplements.join(cols, "dataset_id", "left_anti"), "supplement is not a matrix column", "dataset_id"))
    return union_all(parts)


def matrix(claims: DataFrame, policies: DataFrame, rows: DataFrame, columns: DataFrame, modality: str) -> DataFrame:
    """(ord, label, one column per dataset): cell text of facts, or of policies for policy rows.

    Column names are a short list from the spec and fix the pivot, so the pivot needs no extra pass.
    """
    spec = rows.where(F.col("modality") == modality)
    names = [r["dataset_id"] for r in columns.where(F.col("modality") == modality).orderBy("ord").collect()]
    facts = claims.where(F.col("section") == "facts").select("dataset_id", "key", F.col("text").alias("fact"))
    from_facts = spec.where(~F.col("policy")).join(facts, "key").select("ord", "label", "dataset_id", F.col("fact").alias("text"))
    from_policy = spec.where("policy").join(policies.select("dataset_id", "key", "text"), "key").select("ord", "label", "dataset_id", "text")
    return from_facts.unionByName(from_policy).groupBy("ord", "label").pivot("dataset_id", names).agg(F.first("text")).orderBy("ord")


def labelled_claims(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """All claims with the row label of their key; keys without a row are their own label."""
    labels = rows.groupBy("key").agg(F.max_by("label", "modality").alias("row_label"))
    return claims.join(labels, "key", "left").withColumn("label", F.when(F.col("section") == "facts", F.coalesce("row_label", "key")).otherwise(F.col("key"))).drop("row_label")


def audit(claims: DataFrame) -> DataFrame:
    """(dataset_id, status, n) with totals."""
    return status_cube(claims, "dataset_id", "status")


def kinds(claims: DataFrame) -> DataFrame:
    return claims.groupBy(F.coalesce("kind", F.lit("FACT")).alias("kind")).agg(F.count("*").alias("n"))


def open_claims(claims: DataFrame) -> DataFrame:
    """Ungraded, conflicting and unknown claims with their text, conflict sides spelled out."""
    sides = F.array_join(F.transform("conflict", lambda c: F.concat(c["status"], F.lit(": "), c["claim"], F.lit(" ("), c["source"], F.lit(")"))), "; ")
    text = F.concat_ws(" — ", F.coalesce("text", F.lit("")), F.when(F.size("conflict") > 0, sides))
    return claims.where(F.col("status").isin("UNGRADED", "CONFLICTING", "UNKNOWN")).select("status", "dataset_id", "section", "key", text.alias("text"))


def status_counts(claims: DataFrame, rows: DataFrame, columns: DataFrame, modality: str) -> DataFrame:
    """(dataset_id, status, n) over the card cells of one matrix."""
    spec = rows.where((F.col("modality") == modality) & ~F.col("policy")).select("key")
    cols = columns.where(F.col("modality") == modality).select("dataset_id")
    cells = claims.where(F.col("section") == "facts").join(spec, "key", "left_semi").join(cols, "dataset_id", "left_semi")
    return cells.groupBy("dataset_id", "status").agg(F.count("*").alias("n"))
