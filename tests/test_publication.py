import pytest
from pyspark.sql import functions as F

from sigspark.operators import splits
from sigspark.sources.publication import Publication


@pytest.fixture()
def box(spark, tmp_path):
    return Publication(spark, str(tmp_path))


@pytest.fixture()
def rows(spark):
    return spark.range(50).withColumn("v", F.create_map(F.lit("k"), F.col("id")))


def test_versions_follow_each_other(box, rows):
    assert box.entry("a/b") is None and box.history("a/b") == [] == box.entries()
    first = box.publish("a/b", {"t": rows}, {"note": "ü"})
    assert first["version"] == 1 and box.publish("a/b", {"t": rows})["version"] == 1
    second = box.publish("a/b", {"t": rows.limit(7)}, replace=True)
    assert [e["version"] for e in box.history("a/b")] == [1, 2] and box.read("a/b", "t").count() == 7
    assert box.spark.read.parquet(box.path(first, "t")).count() == 50 and second["folder"] != first["folder"]
    assert [e["id"] for e in box.entries()] == ["a/b"] and box.history("a/b")[0]["info"] == {"note": "ü"}


def test_ids_that_look_alike_stay_apart(box, rows):
    for i, name in enumerate(("a/b", "a_b", "a__b", "A/b", "")):
        box.publish(name, {"t": rows.limit(i + 1)})
    assert [box.read(n, "t").count() for n in ("a/b", "a_b", "a__b", "A/b", "")] == [1, 2, 3, 4, 5]


def test_a_writer_killed_before_its_manifest_changes_nothing(box, rows, monkeypatch):
    box.publish("a", {"t": rows})
    with monkeypatch.context() as m:
        m.setattr(Publication, "_commit", lambda self, entry: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            box.publish("a", {"t": rows.limit(3), "u": rows}, replace=True)
        with pytest.raises(RuntimeError):
            box.publish("new", {"t": rows})
    assert box.read("a", "t").count() == 50 and box.entry("a")["version"] == 1 and box.entry("new") is None
    with pytest.raises(KeyError):
        box.read("a", "u")
    assert box.publish("new", {"t": rows})["version"] == 1 and box.publish("a", {"t": rows.limit(3)}, replace=True)["version"] == 2


def test_of_two_writers_one_wins(box, rows, monkeypatch):
    box.publish("a", {"t": rows})
    stale = box.entry("a")
    box.publish("a", {"t": rows.limit(3)}, replace=True)
    with monkeypatch.context() as m:
        m.setattr(Publication, "entry", lambda self, name: stale)                 # this writer looked before the other committed
        with pytest.raises(Exception, match="AlreadyExists"):
            box.publish("a", {"t": rows.limit(4)}, replace=True)
    assert box.read("a", "t").count() == 3 and len(box.history("a")) == 2


def test_changed_content_and_retired_ids(box, rows):
    box.publish("a", {"t": rows, "none": rows.limit(0)})
    assert box.read("a", "none").count() == 0
    rows.limit(1).write.mode("append").parquet(box.path(box.entry("a"), "t"))
    with pytest.raises(ValueError, match="no longer matches"):
        box.read("a", "t")
    assert box.read("a", "t", verify=False).count() == 51
    box.retire("a", "changed")
    for f in (lambda: box.read("a", "t"), lambda: box.retire("a", "again")):
        with pytest.raises(KeyError):
            f()
    with pytest.raises(ValueError, match="never reused"):
        box.publish("a", {"t": rows}, replace=True)
    assert box.entry("a")["reason"] == "changed" and box.history("a")[0]["retired"] is None


def test_a_split_killed_while_saved_can_be_saved_again(spark, tmp_path, monkeypatch):
    captures = spark.range(20).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("capture_id"), (F.col("id") % 5).alias("group_id"), F.lit(True).alias("label_uas_present"))
    placed, registry = captures.select("capture_id", F.concat(F.lit("f"), (F.col("group_id") % 2).cast("string")).alias("partition")), splits.SplitRegistry(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(Publication, "_commit", lambda self, entry: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            registry.save("d/s", "experiment", "x", captures, placed)
    assert registry.entries().count() == 0
    saved = registry.save("d/s", "experiment", "x", captures, placed, seed=3)
    line = registry.entries().first()
    assert registry.load("d/s").count() == 20 == line["captures"] and line["assignment_sha256"] == saved["assignment_sha256"] and line["counts"]["f0"] == {"true": 12}
    captures.select("capture_id", F.lit("f0").alias("partition")).limit(1).write.mode("append").parquet(registry.published.path(registry.published.entry("d/s"), "assignment"))
    with pytest.raises(ValueError, match="no longer matches"):
        registry.load("d/s")


def test_an_index_is_made_once_and_an_invalid_one_leaves_nothing(spark, tmp_path):
    from sigspark.schemas import INDEX
    from sigspark.sources import tables
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    empty = {name: spark.createDataFrame([], schema) for name, schema in INDEX.items()}
    one = lambda name, **v: spark.createDataFrame([tuple(v.get(f) for f in INDEX[name].fieldNames())], INDEX[name])
    captures = one("captures", capture_id="x/c", dataset_id="x", group_id="x/g", n_artifacts=0, label_status="VERIFIED").mapInArrow(count, INDEX["captures"])
    groups = one("groups", group_id="x/g", dataset_id="x", kind="k", basis="b", status="VERIFIED", n_captures=1)
    assert tables.write_index(empty | {"captures": captures, "groups": groups}, str(tmp_path), "x")["version"] == 1
    assert made.value == 1
    with pytest.raises(ValueError):
        tables.write_index(empty | {"captures": captures}, str(tmp_path), "x")
    assert Publication(spark, str(tmp_path)).entry("x")["version"] == 1 and len(list((tmp_path / "tables").glob("*/*"))) == 1
