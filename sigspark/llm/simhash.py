"""Near duplicates by SimHash and BK-trees (operator 4).

Fingerprints at most ``radius`` bits apart agree in at least ``BANDS - radius`` of BANDS bit bands. Every choice of two equal
bands names a shard; the shard's fingerprints meet in one task, are put into a BK-tree whose children are keyed by their
Hamming distance to the parent, and look up their neighbours along edges within the radius only. A shard tree is handed to
the task that holds the shard's queries and to no other: a broadcast of all trees would grow with the corpus. A crowded
shard is dealt into parts, and every two parts meet once.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, same_row_once, settle
from .components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
BANDS = (11, 11, 11, 11, 10, 10)                    # bits per band, from the lowest; six bands and four errors leave two equal
PART = 4096                                         # fingerprints in one part of a shard
STEP = 1 << 16                                      # shingles hashed at a time


def simhash(text: str | None) -> int:
    """Unsigned fingerprint of one text; without words it is zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()       # bytes: only A-Z are lowered, only ASCII space splits
    if not words:
        return 0
    n = max(len(words) - SHINGLE + 1, 1)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:n - 1].tolist()], (ends[SHINGLE - 1:] - 1).tolist() if len(words) >= SHINGLE else [len(line)]
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        h = np.array([hashed(line[a:b], SEED) for a, b in zip(starts[at:at + STEP], stops[at:at + STEP])], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(t) for t in text], np.uint64).view(np.int64))


class BKTree:
    """Children keyed by the integer distance to their parent."""

    def __init__(self, radius: int):
        self.radius, self.root, self.children = radius, None, {}

    def within(self, value: int) -> list[int]:
        found, todo = [], [] if self.root is None else [self.root]
        while todo:
            node = todo.pop()
            far = (value ^ node).bit_count()
            if far <= self.radius:
                found.append(node)
            edges = self.children.get(node)
            if edges:
                todo.extend(child for key, child in edges.items() if far - self.radius <= key <= far + self.radius)
        return found

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = value
            return
        node = self.root
        while far := (value ^ node).bit_count():
            edges = self.children.setdefault(node, {})
            if far not in edges:
                edges[far] = value
                return
            node = edges[far]


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) for the groups that links of at most ``radius`` bits form inside one shard."""
    tree, parent = BKTree(radius), {}

    def top(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for v in sorted(values, key=lambda v: v & 0xFFFFFFFFFFFFFFFF):
        parent.setdefault(v, v)
        for near in tree.within(v & 0xFFFFFFFFFFFFFFFF):
            a, b = top(v), top(near - (1 << 64) if near >> 63 else near)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v & 0xFFFFFFFFFFFFFFFF)
    return [(v, top(v)) for v in parent if top(v) != v]


def _links_udf(radius: int):
    @F.pandas_udf("array<struct<u:long,v:long>>")
    def links(shards: pd.Series) -> pd.Series:
        return pd.Series([[{"u": u, "v": v} for u, v in shard_links([int(x) for x in s], radius)] for s in shards])
    return links


def links(prints: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """(u, v) with u and v fingerprints of the distinct column ``fp``; the links join exactly those that a chain of distances of at most ``radius`` joins."""
    if not 0 <= radius <= len(BANDS) - 2:
        raise ValueError(f"six bands serve a radius of 0 to {len(BANDS) - 2}")
    offsets = np.cumsum((0, *BANDS))
    band = [F.shiftrightunsigned("fp", int(o)).bitwiseAND(F.lit((1 << b) - 1)) for o, b in zip(offsets, BANDS)]
    shards = F.array(*[F.struct(F.lit(k).alias("pair"), (F.shiftleft(band[i], BANDS[j]) + band[j]).alias("bits")) for k, (i, j) in enumerate(combinations(range(len(BANDS)), 2))])
    member = prints.select("fp", F.explode(shards).alias("shard")).select("fp", F.col("shard.pair").alias("pair"), F.col("shard.bits").alias("bits"))
    crowd = member.groupBy("pair", "bits").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part)
    own = F.pmod(F.xxhash64("fp"), parts)
    dealt = (member.join(crowd, ["pair", "bits"])
             .select("fp", "pair", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
             .select("fp", "pair", "bits", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")))
    tiles = dealt.repartition("pair", "bits", "p", "q").groupBy("pair", "bits", "p", "q").agg(F.collect_list("fp").alias("fps"))    # at most two parts
    return tiles.select(F.explode(_links_udf(radius)("fps")).alias("l")).select("l.u", "l.v").distinct()


def _grouped(docs: DataFrame, radius: int, part: int) -> DataFrame:
    """(fp, doc_id, root, component_id, group_size) per row of ``docs``; root, a fingerprint, names the component."""
    rows = settle(docs.select("doc_id", F.pandas_udf(_fingerprints, "long")("text").alias("fp")))
    prints = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    joined = components(links(prints.select("fp"), radius, part)).withColumnRenamed("u", "fp")
    rooted = prints.join(joined, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    return rows.join(settle(rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id", "group_size")), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, part: int = PART) -> DataFrame:
    """(doc_id, fingerprint, component_id, group_size) per row of ``docs``; fingerprints link at ``radius`` differing bits or fewer.

    Null and empty texts have fingerprint zero, which links like any other. Repeated rows give repeated rows. A component of
    null ids only has a null component_id; otherwise it is the smallest id. Further columns are ignored.
    """
    return _grouped(docs, radius, part).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id (of several, with the smallest fingerprint); all columns unchanged.
    Null and empty texts have fingerprint zero and are one group; of rows equal in id and fingerprint one stays; an empty table stays empty."""
    first = _grouped(docs, radius, PART).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("fp").alias("key"))
    return same_row_once(docs, first.select("doc_id", "key"), F.pandas_udf(_fingerprints, "long")("text"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
