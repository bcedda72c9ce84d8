"""Exact duplicates by deterministic block naming (operator 9): DataFrame functions only.

A text is cut into blocks of fixed size. Distinct blocks are sorted and get integer names, so two blocks have one name if
and only if they are equal. Adjacent names are paired and named again, level by level, until a document has one name.
Only narrow keys (two 64-bit hashes) travel back to the documents, and only after the sorted distinct blocks have proven
that no key stands for two blocks; if one does, the keys are made anew with another salt. So no result rests on a hash.
"""
from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, load, same_row_once, settle

BLOCK_BYTES = 2048
KEY_BITS = 64


def normalised(text: Column) -> Column:
    """Null as empty; runs of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def _blocks(text: Column, size: int) -> Column:
    """Blocks of the UTF-8 bytes; the empty text has one empty block."""
    data = text.cast("binary")
    last = F.greatest(F.floor((F.octet_length(data) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _key(block: Column, salt: int, bits: int) -> Column:
    """Two hashes; fewer than 64 bits (tests) only in the first try."""
    shift = 64 - bits if salt == 0 else 0
    return F.struct(F.shiftright(F.xxhash64(block, F.lit(2 * salt)), shift).alias("a"), F.shiftright(F.xxhash64(block, F.lit(2 * salt + 1)), shift).alias("b"))


def _named(distinct: DataFrame, *by: str) -> DataFrame:
    """An integer name per row: its place in the partition's sort order, after the partition's number."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = KEY_BITS) -> DataFrame:
    """(uid, doc_id, text_sha256, level, name) per row of ``docs``: equal normalised texts, and only those, share (level, name).

    Null texts count as empty. uid numbers the rows, so repeated rows and repeated or null ids stay apart. Any further
    columns are ignored. An empty table gives an empty result.
    """
    texts = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    for salt in count():
        blocks = texts.select(F.explode(_blocks(F.col("t"), block_bytes)).alias("block")).select(_key(F.col("block"), salt, key_bits).alias("key"), "block").distinct()
        names = settle(_named(blocks, "block").select("key", "name"))
        if names.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    rows = settle(texts.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"),
                               F.transform(_blocks(F.col("t"), block_bytes), lambda b: _key(b, salt, key_bits)).alias("keys")))
    level = settle(rows.select("uid", F.size("keys").alias("n"), F.posexplode("keys").alias("at", "key")).join(names, "key").select("uid", "n", "at", "name"))
    longest = level.agg(F.max("n")).first()[0] or 1
    done, height = level.where("n = 1").select("uid", F.lit(0).alias("level"), "name"), 0
    while longest > 1:
        height, longest = height + 1, (longest + 1) // 2
        half = F.shiftright("at", 1)
        pairs = (level.where("n > 1").groupBy("uid", ((F.col("n") + 1) / 2).cast("int").alias("n"), half.alias("at"))
                 .agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")))
        level = settle(pairs.join(_named(pairs.select("left", "right").distinct(), "left", "right"), ["left", "right"]).select("uid", "n", "at", "name"))
        done = done.unionByName(level.where("n = 1").select("uid", F.lit(height).alias("level"), "name"))
    return rows.select("uid", "doc_id", "text_sha256").join(done, "uid")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, key_bits: int = KEY_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row: the row with the smallest doc_id of equal texts stays.

    A null doc_id comes after all others. Of several rows with the smallest doc_id and the same text one stays.
    """
    rows = settle(identities(docs, block_bytes, key_bits))
    # a table of its own: the join then reads two plain exchanges, and a large group of copies can be split
    groups = settle(rows.groupBy("level", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"), F.count("*").alias("group_size")))
    return rows.join(groups, ["level", "name"]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged. Null texts are equal to empty ones; of rows equal in id and text one
    stays; an empty table stays empty."""
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    return same_row_once(docs, exact_duplicates(docs).where("kept").select("doc_id", F.col("text_sha256").alias("key")), digest)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(load(spark, sf_dir, "documents"))


OP9_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       row_number() over (partition by t order by doc_id) = 1 as kept, sha256(t) as text_sha256
from t window w as (partition by t)
"""
