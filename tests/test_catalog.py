"""Catalog checks, claims, name formats and the builders on small listings."""
import pytest
from pyspark.sql import functions as F

from sigspark.functions import grammars as G
from sigspark.operators import catalog, claims
from sigspark.operators.joins import exact_copies
from sigspark.plans import catalog_builders as B
from sigspark.schemas import CLAIMS, INDEX, MATRIX_COLUMNS, MATRIX_ROWS, POLICIES
from sigspark.sources import materialize, tables


def index(spark, **change):
    rows = {"artifacts": [dict(artifact_id="x/a", dataset_id="x", storage_relpath="x/f.zip", capture_id="x/c")],
            "captures": [dict(capture_id="x/c", dataset_id="x", group_id="x/g", n_artifacts=1, label_status="VERIFIED")],
            "groups": [dict(group_id="x/g", dataset_id="x", status="VERIFIED", n_captures=1)], "lineage": [], "evidence": []}
    for name, edit in change.items():
        rows[name] = edit(rows[name])
    return {n: spark.createDataFrame([tuple(r.get(f.name) for f in s) for r in rows[n]], s) for n, s in INDEX.items()}


BREAKAGES = {
    "duplicate id": ("artifacts", lambda r: r * 2, "duplicate artifact_id"),
    "dangling capture": ("artifacts", lambda r: [{**r[0], "capture_id": "x/zzz"}], "unknown capture"),
    "drive path": ("artifacts", lambda r: [{**r[0], "storage_relpath": "D:\\raw"}], "drive path"),
    "wrong count": ("captures", lambda r: [{**r[0], "n_artifacts": 2}], "n_artifacts does not match"),
    "unknown status": ("groups", lambda r: [{**r[0], "status": "SURE"}], "unknown status"),
    "wrong prefix": ("groups", lambda r: [{**r[0], "dataset_id": "y"}], "not under the dataset"),
    "container": ("captures", lambda r: [{**r[0], "stored_in": "x/nothing", "stored_index": None}], "stored_in names no artifact"),
}


def test_a_minimal_index_is_valid(spark):
    assert catalog.index_problems(index(spark), "x").count() == 0


@pytest.mark.parametrize("name", BREAKAGES)
def test_breakages_are_reported(spark, name):
    table, edit, rule = BREAKAGES[name]
    found = [r["rule"] for r in catalog.index_problems(index(spark, **{table: edit}), "x").collect()]
    assert any(rule in f for f in found), found
    with pytest.raises(ValueError):
        catalog.assert_valid(index(spark, **{table: edit}), "x")


def test_index_round_trip(spark, tmp_path):
    tables.write_index(index(spark), str(tmp_path), "x")
    tables.write_index(index(spark), str(tmp_path), "x")                      # replaces, does not append
    assert tables.read_index(spark, str(tmp_path), "artifacts", "x").count() == 1
    assert tables.read_index(spark, str(tmp_path), "captures", "other").count() == 0


# ------------------------------------------------------------------ names
def decoded(spark, name, fmt):
    return spark.createDataFrame([(name,)], "n string").select(G.decode(F.col("n"), fmt).alias("d")).select("d.*").first().asDict()


def test_name_formats(spark):
    assert decoded(spark, "11000H_20.csv", "dronerf_csv") == {"matched": True, "bui": "11000", "band": "H", "segment": 20}
    assert not decoded(spark, "10000X_1.csv", "dronerf_csv")["matched"]
    assert decoded(spark, "pack2_9-10s.iq", "rfuav_iq") == {"matched": True, "pack": 2, "start": 9, "end": 10}
    assert not decoded(spark, "pack1.xml", "rfuav_iq")["matched"]
    d = decoded(spark, "20210329141240MINI0030240312886R290321-T004-005236.wav", "ddl")
    assert (d["segment"], d["seq"], d["class_code"]) == ("T004", 5236, "MINI")
    e = decoded(spark, "46212081_Ed_3p_10_H00_N_C_nw_ev1_M5.wav", "dronenoise_event")
    assert (e["mic"], e["drone"], e["height"]) == (5, "3p", "10")


def test_transmission_paths(spark):
    d = spark.createDataFrame([("CARDRF/LOS/Train/UAV/DJI_INSPIRE/VIDEOING/x.mat",), ("CARDRF/NLOS/WIFI/TPLINK/y.mat",), ("CARDRF/LOS/Train/RADAR/z/q.mat",)], "p string")
    got = [tuple(r["t"]) for r in d.select(G.transmission_path(F.col("p")).alias("t")).collect()]
    assert got[0] == ("LOS", "train", "UAV", "DJI_INSPIRE", "VIDEOING", True) and got[1] == ("NLOS", None, "WIFI", "TPLINK", None, True) and not got[2][5]


# ------------------------------------------------------------------ builders
def members(spark, rows):
    names = B.MEMBERS.fieldNames()
    out = []
    for r in rows:
        r = {"storage_relpath": "raw/x.zip", "member_chain": [r["path"]], "size_bytes": 100, "crc32": "AB", "mtime": "2020", "sha256": r["path"], "meta": {}, **r}
        if r.get("wav") is True:
            r["wav"] = ("pcm", r.pop("ch", 1), 48000.0, 16, 96000, r.pop("s", 1.0))
        out.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(out, B.MEMBERS)


def checked(t, ds):
    assert catalog.index_problems(t, ds).collect() == []
    assert t["problems"].collect() == []
    return t


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_esc50(spark):
    t = checked(B.esc50(members(spark, [dict(path=f"E/audio/{k}.wav", wav=True, meta={"src_file": "s1", "category": "dog", "fold": "2"}) for k in "ab"])), "esc50")
    c = by(t["captures"], "capture_id")["esc50/audio/a"]
    assert (c["label_class"], c["official_split"], c["label_uas_present"], c["label_emitter"], c["duration_s"]) == ("dog", "fold2", False, "none", 1.0)
    assert t["groups"].first()["n_captures"] == 2
    assert by(t["evidence"], "field")["formats"]["value"] == "48000 Hz 16-bit pcm 1 ch"


def test_svanstrom_copies_share_a_group(spark):
    t = checked(B.svanstrom(members(spark, [dict(path=f"DRONE_{k}.wav", storage_relpath=f"s/DRONE_{k}.wav", wav=True, sha256="x" if k < 2 else "y") for k in range(3)])), "svanstrom")
    assert t["groups"].count() == 2 and t["lineage"].first()["object"] == "s/DRONE_0.wav"


def test_uavirbase_and_miesikowska(spark):
    meta = {"sound_source": "Drone", "type": "X", "distance": "5", "height": "2", "azimuth": "90", "rotation": "cw", "movement": "hover", "start_recording_time": "2024-01-01 10:00:00", "wind_speed": "3"}
    t = checked(B.uavirbase(members(spark, [dict(path="r1/output.wav", wav=True, ch=8, meta=meta), dict(path="r2/output.wav", wav=True, ch=8, meta={"sound_source": "Ambient", "start_recording_time": "2024-01-01 11:00:00"})])), "uavirbase")
    c = by(t["captures"], "capture_id")
    assert c["uavirbase/r1"]["recorded_at"] == "2024-01-01T10:00:00" and len(c["uavirbase/r1"]["channels"]) == 8 and c["uavirbase/r2"]["label_condition"] == "ambient"
    m = checked(B.miesikowska_uav(members(spark, [dict(path="q/x4_d1_mavic_10m_5m_210504_1_sekwencja.wav", wav=True), dict(path="q/x4_d1_mavic_10m_5m_210504_2.wav", wav=True), dict(path="q/n.xlsx")])), "miesikowska_uav")
    assert m["groups"].first()["n_captures"] == 2 and m["captures"].where("label_condition like '%speech%'").first()["recorded_at"] == "2021-05-04"


def test_dronenoise_event_is_one_capture(spark):
    t = checked(B.dronenoise(members(spark, [dict(path=f"Ed_3p_10_H00_N_ev1_M{m}.wav", wav=True, s=2.0 - m / 10, crc32=str(m % 2)) for m in (1, 2, 3)] + [dict(path="Calib_Scotland_ch1.wav", wav=True, crc32="9")])), "dronenoise")
    c = by(t["captures"], "capture_id")["dronenoise/Ed_3p_10_H00_N_ev1"]
    assert c["n_artifacts"] == 3 and c["channels"] == ["M1", "M2", "M3"] and abs(c["duration_s"] - 1.7) < 1e-9 and c["label_condition"] == "hover, 10 m"
    assert by(t["captures"], "capture_id")["dronenoise/Calib_Scotland_ch1"]["label_uas_present"] is None
    assert t["lineage"].count() == 1 and by(t["evidence"], "field")["microphones_present"]["value"] == "M1,M2,M3"


def test_ddl_runs_and_unusable_clips(spark):
    def name(k):
        return f"day1/T004/20210329141240MINI0030240312886R290321-T004-{k:06d}.wav"
    rows = [dict(path=name(k), wav=True, ch=8, s=0.1, size_bytes=1000) for k in (0, 1, 2, 4, 5)] + [dict(path=name(6), size_bytes=44), dict(path="day1/T004/odd.wav", size_bytes=1000)]
    t = checked(B.ddl(members(spark, rows)), "ddl")
    c = by(t["captures"], "capture_id")
    assert set(c) == {"ddl/day1/T004/000000-000002", "ddl/day1/T004/000004-000005"}
    assert c["ddl/day1/T004/000000-000002"]["n_artifacts"] == 3 and c["ddl/day1/T004/000000-000002"]["label_class"] == "DJI Mini 2" and c["ddl/day1/T004/000000-000002"]["recorded_at"] == "2021-03-29T14:12:40"
    assert t["artifacts"].where("capture_id is null").count() == 2


def test_dronerf_pairs(spark):
    def row(bui, band, k, folder):
        return dict(path=f"{bui}{band}_{k}.csv", member_chain=[f"top/{folder}/RF Data_1.rar", f"{bui}{band}_{k}.csv"])
    rows = [row("11000", b, k, "Phantom drone") for b in "LH" for k in (0, 1)] + [row("00000", b, 0, "Background RF activites") for b in "LH"]
    t = checked(B.dronerf(members(spark, rows)), "dronerf")
    c = by(t["captures"], "capture_id")["dronerf/11000/segment_0"]
    assert (c["channels"], c["label_class"], c["label_condition"], c["label_emitter"]) == (["H", "L"], "DJI Phantom 3", "on_connected", "uas_link")
    bad = B.dronerf(members(spark, rows[:-1] + [row("11000", "L", 3, "AR drone")]))["problems"]
    assert {"incomplete pair", "folder and name disagree", "segment numbers are not consecutive from 0"} <= {r["rule"] for r in bad.collect()}


def test_cardrf_blocks_and_groups(spark):
    def row(path, date):
        return dict(path=path, meta={"date": date, "model": "M", "serial": "1", "num_points": "5000000", "x_inc": "5e-11"})
    rows = [row("CARDRF/LOS/Train/UAV/DJI/FLYING/a.mat", "25-Aug-2020  1:50:40"), row("CARDRF/LOS/Test/UAV_Controller/DJI/b.mat", "25-Aug-2020  2:50:40"), row("CARDRF/NLOS/UAV/DJI/FLYING/c.mat", "25-Aug-2020  3:50:41"),
            dict(path="__MACOSX/CARDRF/x.mat")]
    t = checked(B.cardrf(members(spark, rows)), "cardrf")
    assert t["groups"].first()["group_id"] == "cardrf/UAS/DJI" and t["groups"].first()["n_captures"] == 3 and t["groups"].first()["kind"] == "uas_system"
    c = by(t["captures"], "capture_id")["cardrf/CARDRF/LOS/Train/UAV/DJI/FLYING/a"]
    assert c["recorded_at"] == "2020-08-25T01:50:40" and abs(c["duration_s"] - 250e-6) < 1e-12 and c["official_split"] == "train"
    e = by(t["evidence"], "field")
    assert e["recording_blocks"]["value"].count("→") == 2 and e["macosx_junk_entries_skipped"]["value"] == "1"


def test_uavsig_labels(spark):
    meta = {"samples": "50000000", "transmissions": "3", "created": "Mon Mar 25 10:00:00 2024"}
    rows = [dict(path="Drone/s1/drone_1200_03.mat", meta=meta), dict(path="Controller/s/controller_p2_0000_05.mat", meta=meta)]
    official = spark.createDataFrame([(r["path"], 100) for r in rows] + [("Drone/s1/other.mat", 5)], "path string, size_bytes long")
    t = checked(B.uavsig(members(spark, rows), official), "uavsig")
    c = by(t["captures"], "capture_id")
    d, k = c["uavsig/Drone/s1/drone_1200_03"], c["uavsig/Controller/s/controller_p2_0000_05"]
    assert (d["label_class"], d["label_condition"], d["label_uas_present"]) == ("drone_1+drone_2", "drone_1:ch1, drone_2:ch2", True)
    assert (k["label_uas_present"], k["label_emitter"], k["label_condition"], k["label_class"]) == (False, "none", "arrangement p2", None)
    assert by(t["evidence"], "field")["local_subset"]["value"] == "Controller: 1 of 1; Drone: 1 of 2"


def test_noisy_rf_captures_live_in_one_tensor(spark):
    v = spark.createDataFrame([(0, "Noise", -10, 0.5), (1, "DJI", 0, 0.7)], "index long, class string, snr int, duty double")
    n = spark.createDataFrame([("Noise", 1), ("DJI", 1)], "class string, n long")
    s = spark.createDataFrame([(-10, 1), (0, 1)], "snr int, n long")
    t = checked(B.noisy_rf(members(spark, [dict(path="dataset.pt")]), v, n, s), "noisy_rf")
    assert t["captures"].where("stored_index = 1").first()["label_emitter"] == "controller" and t["groups"].first()["status"] == "UNKNOWN"
    wrong = B.noisy_rf(members(spark, [dict(path="dataset.pt")]), v, n.withColumn("n", F.lit(5)), s)
    assert wrong["problems"].count() == 2


def test_drff_copies_and_units(spark):
    def meta(**m):
        return {"Fs": "1e8", "CenterFreq": "2.44e9", "TD": "mavic_1", "D": "d1", "U": "u1", "State": "hover", **m}
    rows = [dict(path="DRFF-R2/dataset3-single_drone_hover/a.mat", sha256="1", meta=meta(NTD1="none")), dict(path="DRFF-R2/dataset7-environment/e.mat", sha256="2", meta=meta()),
            dict(path="DRFF-R2/dataset5-single_drone_inside_absorbent_cotton/dataset7-environment/e.mat", sha256="2", storage_relpath="copy", meta=meta()), dict(path="a.mat", sha256="zz", storage_relpath="stray", meta=meta())]
    t = checked(B.drff_r2(members(spark, rows)), "drff_r2")
    c = by(t["captures"], "capture_id")
    assert set(c) == {"drff_r2/dataset3-single_drone_hover/a", "drff_r2/dataset7-environment/e"}
    assert c["drff_r2/dataset3-single_drone_hover/a"]["group_id"] == "drff_r2/mavic_1/d1" and c["drff_r2/dataset3-single_drone_hover/a"]["label_class"] == "mavic_1"
    assert {r["subject"]: r["relation"] for r in t["lineage"].collect()} == {"copy": "exact_copy_of", "stray": "unmatched"}
    assert t["evidence"].where("field = 'mat.U'").count() == 2


def test_rfuav_runs_and_swapped_xml(spark):
    xml = {f: "1" for f in B.RFUAV_FIELDS} | {"SampleRate": "1e8", "CenterFrequency": "2.4e9", "ReferenceSNRLevel": "10", "Drone": "MAVIC 3", "SerialNumber": "S"}
    rows = [dict(path=f"MAVIC3/pack2_{k}-{k + 1}s.iq", size_bytes=800_000_000) for k in (0, 1, 3)] + [dict(path="MAVIC3/pack1.xml", meta=xml)]
    official = spark.createDataFrame([("raw/x.zip", "MAVIC3.rar", "h", "h")], "storage_relpath string, official string, sha256 string, local_sha256 string")
    t = checked(B.rfuav(members(spark, rows), official), "rfuav")
    c = by(t["captures"], "capture_id")
    assert set(c) == {"rfuav/MAVIC3/pack2_0-2s", "rfuav/MAVIC3/pack2_3-4s"} and c["rfuav/MAVIC3/pack2_0-2s"]["duration_s"] == 2.0
    e = by(t["evidence"], "field")
    assert e["xml_link"]["status"] == "CONFLICTING" and e["missing_chunks_s"]["value"] == "2-3s" and "label_disagreement" not in e


def test_rma_archives(spark):
    meta = {"created": "Tue Mar  5 10:00:00 2024", "samples": "140000000"}
    rows = [dict(path="MavicRC1/Mavic_1.mat", storage_relpath="rma/MavicRC1.zip", meta=meta), dict(path="SJRC_pro/x_1.mat", storage_relpath="rma/SJRC_pro.zip", meta=meta)]
    official = spark.createDataFrame([("rma/MavicRC1.zip", 5, 5), ("rma/SJRC_pro.zip", 6, 7)], "path string, size_bytes long, local_size long")
    t = checked(B.rma(members(spark, rows), official), "rma")
    c = by(t["captures"], "capture_id")
    assert c["rma/MavicRC1/Mavic_1"]["recorded_at"] == "2024-03-05T10:00:00" and c["rma/SJRC_pro/x_1"]["label_emitter"] is None and c["rma/MavicRC1/Mavic_1"]["duration_s"] == 1.4


def test_every_dataset_has_a_builder():
    assert len(B.BUILDERS) == 13


# ------------------------------------------------------------------ claims
def claim(spark, **c):
    base = dict(dataset_id="d", modality="rf", section="facts", key="k", label="K", text="t", kind="FACT", status="VERIFIED", source="s")
    return spark.createDataFrame([tuple({**base, **c}.get(f.name) for f in CLAIMS)], CLAIMS)


SIDE = ("a", "VERIFIED", "s", None, None)
BAD_CLAIMS = {"EMPIRICAL needs": dict(status="EMPIRICAL"), "go together": dict(status="EMPIRICAL", n=3), "needs a source": dict(source=None), "at least two": dict(status="CONFLICTING", conflict=[SIDE]),
              "only CONFLICTING": dict(conflict=[SIDE, SIDE]), "cannot carry n": dict(status="UNKNOWN", n=1, n_unit="file"), "bare bar": dict(text="a|b"), "one line": dict(text="a\nb"),
              "not both": dict(section="signal", value="1", varies=True), "not neither": dict(section="signal"), "must be empty": dict(section="signal", status="UNKNOWN", value="1"), "unknown status": dict(status="SURE")}


@pytest.mark.parametrize("rule", BAD_CLAIMS)
def test_claim_rules(spark, rule):
    found = [r["rule"] for r in claims.claim_problems(claim(spark, **BAD_CLAIMS[rule])).collect()]
    assert any(rule in f for f in found), found


def test_good_claims(spark):
    for c in (dict(), dict(text="a \\| b"), dict(status="EMPIRICAL", n=3, n_unit="file"), dict(status="UNKNOWN", source=None), dict(status="CONFLICTING", source=None, conflict=[SIDE, SIDE]), dict(section="signal", value="1", text=None, kind=None)):
        assert claims.claim_problems(claim(spark, **c)).collect() == [], c


def test_matrix_and_spec(spark):
    c = claim(spark, key="rate", text="50 MS/s").unionByName(claim(spark, dataset_id="e", key="other", text="x"))
    p = spark.createDataFrame([("d", "role", "train", None)], POLICIES)
    rows = spark.createDataFrame([("rf", "rate", "Rate", False, 1), ("rf", "role", "Role", True, 2)], MATRIX_ROWS)
    cols = spark.createDataFrame([("rf", "d", "D", 1), ("rf", "e", "E", 2)], MATRIX_COLUMNS)
    m = {r["label"]: (r["d"], r["e"]) for r in claims.matrix(c, p, rows, cols, "rf").collect()}
    assert m == {"Rate": ("50 MS/s", None), "Role": ("train", None)}
    found = {(r["rule"], r["entity_id"]) for r in claims.spec_problems(c, p, rows, cols, "rf").collect()}
    assert found == {("fact missing for a row", "e/rate"), ("fact for no row of the matrix", "e/other"), ("no policy entry", "e")}


def test_exact_copies_and_materialize(spark, tmp_path):
    s = spark.createDataFrame([("a", 1, "c"), ("b", 2, "c")], "path string, size long, crc string")
    o = spark.createDataFrame([("z", 1, "c"), ("y", 1, "c")], "path string, size long, crc string")
    assert {r["subject"]: (r["relation"], r["object"]) for r in exact_copies(s, o, ["size", "crc"], "path", "path", "m").collect()} == {"a": ("exact_copy_of", "y"), "b": ("unmatched", None)}
    calls = []

    def build():
        calls.append(1)
        return s.withColumn("f", F.lit(1.0))
    for _ in range(2):
        assert materialize.materialize(spark, str(tmp_path), "f", {"w": 1}, {"s": s}, build).count() == 2
    assert len(calls) == 1
    materialize.materialize(spark, str(tmp_path), "f", {"w": 2}, {"s": s}, build)
    materialize.materialize(spark, str(tmp_path), "f", {"w": 1}, {"s": s.limit(1)}, build)
    assert len(calls) == 3


def test_claim_files_name_their_dataset(spark, tmp_path):
    claim(spark, dataset_id="d").toJSON().coalesce(1).saveAsTextFile(str(tmp_path / "out"))
    import glob
    import shutil
    shutil.copy(glob.glob(str(tmp_path / "out" / "part-*"))[0], tmp_path / "d.json")
    shutil.copy(tmp_path / "d.json", tmp_path / "e.json")
    got = tables.claim_file_problems(tables.read_claims(spark, str(tmp_path / "[de].json"))).collect()
    assert [r["detail"] for r in got] == ["e"]


def test_keys_never_go_through_the_driver(spark, tmp_path):
    """Ids pack so well that a table of millions looks small enough to broadcast; small tables stand for it here."""
    from sigspark.plans import catalog_queries as Q
    spark.createDataFrame([(k, k % 3, "O" if k % 2 else "F") for k in range(20)], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k % 15, k // 15, k, 2.0) for k in range(40)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = Q._valid_index(spark, str(tmp_path), spark.read.parquet(f"{tmp_path}/orders.parquet"))
    for name, t in made.items():
        t.write.parquet(f"{tmp_path}/index/{name}")
    written = {name: spark.read.parquet(f"{tmp_path}/index/{name}") for name in made}
    found, answer = catalog.index_problems(written, "t"), Q.published_index(spark, str(tmp_path))
    for df in (*made.values(), found, answer):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0 and catalog.dangling(written["artifacts"], "capture_id", written["captures"].where("capture_id <> 't/o4'"), "capture_id", "artifact_id", "lost").count() == 3
    assert {(r["o_orderkey"], r["n_artifacts"], r["size_bytes"]) for r in answer.collect()} == {(k, (3 if k < 10 else 2) if k < 15 else 0, (6 if k < 10 else 4) if k < 15 else 0) for k in range(20)}
