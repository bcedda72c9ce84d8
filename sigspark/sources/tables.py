"""Index tables, small metadata files and claim tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import catalog
from ..schemas import CLAIMS, INDEX
from .publication import Publication


def read_index(spark: SparkSession, root: str, name: str, dataset_id: str | None = None, verify: bool = False) -> DataFrame:
    """One index table of one dataset or of all; only the files of their latest versions are listed. ``verify`` also compares each
    dataset's content with its manifest. Unknown and retired datasets have no rows."""
    schema, index = INDEX[name], Publication(spark, root)
    if "dataset_id" not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField("dataset_id", T.StringType())])
    known = index.entries() if dataset_id is None else [e for e in [index.entry(dataset_id)] if e]
    live = [e for e in known if not e["retired"]]
    if verify:
        for e in live:
            index.read(e["id"], name)
    if not live:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[index.path(e, name) for e in live])


def write_index(tables: dict[str, DataFrame], root: str, dataset_id: str) -> dict:
    """Write the five tables of one dataset, validate what was written, then publish it as the next version, all at once.
    Returns the manifest.

    Every rule reads its tables anew; the written ones are made once and give a rule only the columns it needs."""
    out = {name: tables[name].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]) for name, schema in INDEX.items()}
    out = {name: t if "dataset_id" in t.columns else t.withColumn("dataset_id", F.lit(dataset_id)) for name, t in out.items()}
    return Publication(tables["captures"].sparkSession, root).publish(dataset_id, out, replace=True, check=lambda written: catalog.assert_valid(written, dataset_id))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, **options: str) -> DataFrame:
    return spark.read.schema(schema).options(header="true", mode="FAILFAST", **options).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).options(multiLine=str(multiline).lower(), mode="FAILFAST").json(path)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claim rows from JSON lines, one file per dataset; a corrupt line is kept in ``_corrupt`` for the checks."""
    schema = T.StructType([*CLAIMS.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.withColumn("file_stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1))


def claim_file_problems(claims: DataFrame) -> DataFrame:
    """Corrupt lines, and files whose name is not the id they carry."""
    named = claims.where(~F.col("dataset_id").eqNullSafe(F.col("file_stem")))
    return named.select(F.when(F.col("_corrupt").isNotNull(), "unreadable line").otherwise("id does not match the file name").alias("rule"),
                        F.coalesce("dataset_id", "file_stem").alias("entity_id"), F.col("file_stem").alias("detail"))
