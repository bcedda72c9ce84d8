"""Catalogs of thirteen public datasets from landed listings.

Every builder takes ``members``, one row per stored file or archive member, and returns the five index tables plus
``problems``. Columns of ``members`` (see MEMBERS): where it is stored, its name inside the release, size, checksums,
the WAV header for audio, and ``meta``, a map of the metadata the release keeps beside or inside the file. How members
get there (zip listings, WAV heads, landed MAT or XML fields) is the business of ``sources.ingest``.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grammars as G
from ..functions.columns import first_filled, iso_timestamp, strip_weekday
from ..operators import catalog, profiles, sequences
from ..operators.joins import exact_copies, with_canonical
from ..schemas import EVIDENCE, INDEX, LINEAGE

Tables = dict[str, DataFrame]

MEMBERS = T.StructType([
    T.StructField("storage_relpath", T.StringType()), T.StructField("member_chain", T.ArrayType(T.StringType())), T.StructField("path", T.StringType()),
    T.StructField("size_bytes", T.LongType()), T.StructField("crc32", T.StringType()), T.StructField("mtime", T.StringType()),
    T.StructField("sha256", T.StringType()),
    T.StructField("wav", T.StructType([T.StructField("format", T.StringType()), T.StructField("channels", T.IntegerType()),
                                       T.StructField("sample_rate_hz", T.DoubleType()), T.StructField("bits", T.IntegerType()),
                                       T.StructField("data_bytes", T.LongType()), T.StructField("duration_s", T.DoubleType())])),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])

# What a builder may say about an artifact's capture; missing columns are NULL
_ATTRIBUTES = {"recorded_at": "string", "start_s": "double", "center_frequency_hz": "double", "sample_rate_hz": "double", "reference_snr_db": "double",
               "official_split": "string", "label_uas_present": "boolean", "label_emitter": "string", "label_class": "string", "label_condition": "string"}


def file_name(path: Column | str = "path") -> Column:
    return F.element_at(F.split(path if isinstance(path, Column) else F.col(path), "/"), -1)


def folder(path: Column | str = "path") -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def without(value: Column | str, suffix: str) -> Column:
    return F.regexp_replace(value, suffix.replace(".", r"\.") + "$", "")


def meta(name: str, kind: str = "string") -> Column:
    return F.col("meta")[name].try_cast(kind)


def under(ds: str, *parts: Column | str) -> Column:
    return F.concat_ws("/", F.lit(ds), *[p if isinstance(p, Column) else F.col(p) for p in parts])


def evidence(entity: Column, field: str | Column, value: Column, status: str | Column, source: str, n: Column | None = None) -> list[Column]:
    def text(v: str | Column) -> Column:
        return F.lit(v) if isinstance(v, str) else v
    return [entity.alias("entity_id"), text(field).alias("field"), value.cast("string").alias("value"), text(status).alias("status"),
            F.lit(source).alias("source"), (F.lit(None) if n is None else n).cast("long").alias("n")]


def assemble(ds: str, rows: DataFrame, media_type: str, label_source: str, group: tuple[str | Column, str | Column, str], *, join_parts=F.sum,
             label_status: str = "AUTHOR_DOC", channels: Column | None = None, extra_evidence: list[DataFrame] = (), lineage: list[DataFrame] = (),
             problems: list[DataFrame] = ()) -> Tables:
    """Artifacts as given; captures as the artifacts that share a capture id; groups counted from captures.

    rows: MEMBERS plus artifact_id, capture_id (NULL for artifacts without one), group_id and any of channel, part_index,
    duration_s and the capture attributes. A capture takes its attributes from its first part.
    """
    for name, kind in {"channel": "string", "part_index": "int", "duration_s": "double", **_ATTRIBUTES}.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    artifacts = rows.select("artifact_id", F.lit(ds).alias("dataset_id"), "storage_relpath", "member_chain", "size_bytes", F.lower("crc32").alias("crc32"),
                            F.col("mtime").alias("member_mtime"), F.lit(media_type).alias("media_type"), "capture_id", "channel", F.col("part_index").cast("int").alias("part_index"))
    live = rows.where(F.col("capture_id").isNotNull())
    named = F.array_sort(F.collect_set("channel")) if channels is None else F.min_by(channels, F.coalesce("part_index", F.lit(0)))
    first = F.min_by(F.struct(*[F.col(a).cast(k).alias(a) for a, k in _ATTRIBUTES.items()]), F.struct(F.coalesce("part_index", F.lit(0)), F.col("artifact_id")))
    captures = (live.groupBy("capture_id", "group_id").agg(F.count("*").cast("int").alias("n_artifacts"), named.alias("channels"),
                                                           join_parts("duration_s").alias("duration_s"), first.alias("a"))
                .select("capture_id", F.lit(ds).alias("dataset_id"), "group_id", "n_artifacts", F.lit(None).cast("string").alias("stored_in"),
                        F.lit(None).cast("long").alias("stored_index"), "channels", "duration_s", "a.*", F.lit(label_source).alias("label_source"),
                        F.lit(label_status).alias("label_status")))
    captures = captures.select(*[F.col(f.name).cast(f.dataType) for f in INDEX["captures"]])
    return finish(ds, artifacts, captures, catalog.groups_from(captures, *group), list(lineage), list(extra_evidence), list(problems))


def finish(ds: str, artifacts: DataFrame, captures: DataFrame, groups: DataFrame, lineage: list[DataFrame], more: list[DataFrame], problems: list[DataFrame]) -> Tables:
    spark = artifacts.sparkSession
    totals = captures.agg(F.count("*").alias("n")).select(*evidence(F.lit(ds), "captures", F.col("n"), "VERIFIED", "member listing", F.col("n")))
    empty_problems = spark.createDataFrame([], "rule string, entity_id string, detail string")
    return {"artifacts": artifacts, "captures": captures, "groups": groups,
            "lineage": catalog.union_all([spark.createDataFrame([], LINEAGE), *lineage]),
            "evidence": catalog.union_all([spark.createDataFrame([], EVIDENCE), totals, *more]), "problems": catalog.union_all([empty_problems, *problems])}


def wav_formats(ds: str, rows: DataFrame) -> DataFrame:
    """Evidence: the distinct sample formats, spelled out."""
    w = rows.where(F.col("wav.format").isNotNull())
    text = F.concat(F.col("wav.sample_rate_hz").cast("int").cast("string"), F.lit(" Hz "), F.col("wav.bits").cast("string"), F.lit("-bit "), F.col("wav.format"),
                    F.lit(" "), F.col("wav.channels").cast("string"), F.lit(" ch"))
    named = profiles.distinct_text(w.select(F.lit(ds).alias("ds"), text.alias("fmt")), ["ds"], "fmt")
    n = w.agg(F.count("*").alias("n"))
    return named.join(F.broadcast(n)).select(*evidence(F.col("ds"), "formats", F.col("values"), "VERIFIED", "WAV headers", F.col("n")))


def count_evidence(entity: str, field: str, rows: DataFrame, source: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select(*evidence(F.lit(entity), field, F.col("n"), "VERIFIED", source))


def unexpected(rows: DataFrame, bad: Column, rule: str) -> DataFrame:
    return catalog.problem(rows.where(F.coalesce(bad, F.lit(True))), rule, "path")


def audio_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"duration_s": F.col("wav.duration_s"), "sample_rate_hz": F.col("wav.sample_rate_hz")})


def sound_source(rows: DataFrame, present: Column) -> DataFrame:
    return rows.withColumns({"label_uas_present": present, "label_emitter": F.when(present, "aircraft").when(~present, "none")})


def wav_channel_names() -> Column:
    return F.transform(F.sequence(F.lit(1), F.col("wav.channels")), lambda c: c.cast("string"))


# ------------------------------------------------------------------ acoustic
def esc50(members: DataFrame) -> Tables:
    """5 s clips; clips cut from one source recording belong together. meta: src_file, category, fold."""
    ds = "esc50"
    rows = members.where(F.col("path").like("%/audio/%.wav"))
    rows = sound_source(audio_columns(rows), F.lit(False)).withColumns({
        "artifact_id": under(ds, "path"), "capture_id": under(ds, F.lit("audio"), without(file_name(), ".wav")), "group_id": under(ds, F.lit("src_file"), meta("src_file")),
        "label_class": meta("category"), "official_split": F.concat(F.lit("fold"), meta("fold"))})
    return assemble(ds, rows, "audio/wav", "meta/esc50.csv", ("src_file", "clips of one source recording", "AUTHOR_DOC"), channels=F.array().cast("array<string>"),
                    extra_evidence=[wav_formats(ds, rows)], problems=[unexpected(rows, meta("src_file").isNull(), "clip without metadata row")])


def svanstrom(members: DataFrame) -> Tables:
    """10 s clips; byte-identical clips share the group of the first name. meta: none; sha256 required."""
    ds = "svanstrom"
    stem = without(file_name(), ".wav")
    rows = members.where(F.col("path").like("%.wav")).withColumn("stem", stem)
    rows = with_canonical(rows, "sha256", "stem")
    kind = F.split("stem", "_")[0]
    rows = sound_source(audio_columns(rows), kind == "DRONE").withColumns({
        "artifact_id": under(ds, F.lit("Data/Audio"), file_name()), "capture_id": under(ds, F.lit("Data/Audio"), "stem"), "group_id": under(ds, F.lit("clip"), "canonical"),
        "label_class": F.lower(kind)})
    same = rows.where(F.col("stem") != F.col("canonical")).select(
        F.col("storage_relpath").alias("subject"), F.lit("identical_content_to").alias("relation"),
        F.concat(folder("storage_relpath"), F.lit("/"), F.col("canonical"), F.lit(".wav")).alias("object"), F.lit("equal SHA-256").alias("method"), F.lit("VERIFIED").alias("status"))
    return assemble(ds, rows, "audio/wav", "file name prefix", ("clip", "one clip with its byte-identical copies", "VERIFIED"), channels=F.array().cast("array<string>"),
                    extra_evidence=[wav_formats(ds, rows)], lineage=[same])


def uavirbase(members: DataFrame) -> Tables:
    """Eight-channel recordings. meta (label.json): sound_source, type, distance, height, azimuth, rotation, movement,
    start_recording_time, wind_speed."""
    ds = "uavirbase"
    rows = members.where(F.col("path").like("%/output.wav"))
    drone = F.coalesce(meta("sound_source") == "Drone", F.lit(False))
    condition = F.concat(F.lit("distance "), meta("distance"), F.lit(" m, height "), meta("height"), F.lit(" m, azimuth "), meta("azimuth"), F.lit(", "),
                         meta("rotation"), F.lit(", "), meta("movement"))
    rows = sound_source(audio_columns(rows), drone).withColumns({
        "artifact_id": under(ds, "path"), "capture_id": under(ds, folder()), "group_id": under(ds, folder()), "label_class": F.when(drone, meta("type")),
        "label_condition": F.when(drone, condition).otherwise("ambient"), "recorded_at": F.replace(meta("start_recording_time"), F.lit(" "), F.lit("T"))})
    wind = rows.select(*evidence(F.col("capture_id"), "label.wind_speed", meta("wind_speed"), "AUTHOR_DOC", "label.json"))
    return assemble(ds, rows, "audio/wav", "label.json", ("recording", "one recording", "AUTHOR_DOC"), channels=wav_channel_names(),
                    extra_evidence=[wav_formats(ds, rows), wind, count_evidence(ds, "ambient_recordings", rows.where(~F.col("label_uas_present")), "label.json")])


def dronenoise(members: DataFrame) -> Tables:
    """One file per microphone; an event is one capture of up to nine microphones. Calibration tones are their own group."""
    ds = "dronenoise"
    rows = members.where(F.col("path").like("%.wav")).withColumns({"e": G.decode(F.col("path"), "dronenoise_event"), "c": G.decode(F.col("path"), "dronenoise_calibration")})
    event, calibration = F.col("e.matched"), F.col("c.matched")
    height_text = F.concat(F.when(F.col("e.operation") == "F15", "flyover 15 m/s").otherwise("hover"), F.lit(", "), F.col("e.height"), F.lit(" m"))
    group = F.concat(F.lit("Ed_"), F.concat_ws("_", "e.drone", "e.height", "e.operation", "e.rest"), F.lit("_ev"), F.col("e.event"))
    rows = sound_source(audio_columns(rows), F.when(event, F.lit(True))).withColumns({
        "artifact_id": under(ds, "path"), "capture_id": F.when(event, under(ds, F.regexp_replace("path", r"_M\d\.wav$", ""))).when(calibration, under(ds, without("path", ".wav"))),
        "group_id": F.when(event, under(ds, group)).when(calibration, F.lit(f"{ds}/calibration")), "channel": F.when(event, F.concat(F.lit("M"), F.col("e.mic").cast("string"))),
        "label_class": F.when(event, F.col("e.drone")).when(calibration, "calibration_tone"),
        "label_condition": F.when(event, height_text).when(calibration, F.concat(F.lit("channel "), F.col("c.channel")))})
    microphones = rows.where(event).groupBy("capture_id").agg(F.array_join(F.array_sort(F.collect_list("channel")), ",").alias("m"), F.count("*").alias("n")).where("n <> 9")
    copies = with_canonical(rows.withColumn("content", F.concat_ws(":", "size_bytes", "crc32")), "content", "path").where(F.col("path") != F.col("canonical")).select(
        F.concat_ws("::", "storage_relpath", "path").alias("subject"), F.lit("identical_content_to").alias("relation"), F.concat_ws("::", "storage_relpath", "canonical").alias("object"),
        F.lit("equal size and CRC32").alias("method"), F.lit("VERIFIED").alias("status"))
    return assemble(ds, rows, "audio/wav", "file name", ("event", "one flyover or hover, all its microphones; calibration apart", "AUTHOR_DOC"), join_parts=F.min,
                    extra_evidence=[wav_formats(ds, rows), microphones.select(*evidence(F.col("capture_id"), "microphones_present", F.col("m"), "VERIFIED", "member listing"))],
                    lineage=[copies], problems=[unexpected(rows, ~(event | calibration), "unexpected file name")])


def miesikowska_uav(members: DataFrame) -> Tables:
    """Mono recordings; takes of one drone at one position are repeats."""
    ds = "miesikowska_uav"
    audio = F.lower("path").like("%.wav")
    rows = members.where(audio).withColumn("m", G.decode(file_name(), "miesikowska"))
    speech = F.lower("m.rest").contains("sekwencja")
    rows = sound_source(audio_columns(rows), F.lit(True)).withColumns({
        "artifact_id": under(ds, file_name("storage_relpath"), "path"), "capture_id": F.when(F.col("m.matched"), under(ds, F.regexp_replace("path", r"\.[^.]*$", ""))),
        "group_id": under(ds, "m.drone", F.concat("m.altitude", F.lit("m_"), "m.offset", F.lit("m"))), "label_class": F.col("m.model"),
        "label_condition": F.concat(F.lit("altitude "), "m.altitude", F.lit(" m, offset "), "m.offset", F.lit(" m"), F.when(speech, ", speech commands").otherwise("")),
        "recorded_at": F.date_format(F.to_timestamp_ntz(F.concat(F.lit("20"), "m.date"), F.lit("yyyyMMdd")), "yyyy-MM-dd")})
    return assemble(ds, rows, "audio/wav", "file name", ("drone_position", "one drone at one position", "INFERRED"), channels=F.array().cast("array<string>"),
                    extra_evidence=[wav_formats(ds, rows), count_evidence(ds, "non_audio_members", members.where(~audio), "member listing")],
                    problems=[unexpected(rows, ~F.col("m.matched"), "unexpected file name")])


# Fixed values
DDL_CLASSES = {"MINI": "DJI Mini 2", "PRO4": "DJI Phantom 4 Pro"}
DDL_EMPTY_BYTES = 44


def ddl(members: DataFrame) -> Tables:
    """0.1 s eight-channel clips; a gap-free run of clip numbers in a segment folder is one capture. Empty clips and
    unreadable names stay artifacts without a capture."""
    ds = "ddl"
    rows = members.withColumns({"d": G.decode(file_name(), "ddl"), "folder": folder(), "artifact_id": under(ds, "path")})
    usable = F.col("d.matched") & (F.col("size_bytes") > DDL_EMPTY_BYTES)
    good = rows.where(usable).withColumn("seq", F.col("d.seq"))
    spans = sequences.runs(good, ["folder"], "seq").select("folder", "first", "last")
    # a clip finds its run through the run's first number: the scan numbers clips inside a run
    scan = sequences.ordered(good.select("folder", "seq").distinct(), ["folder"], ["seq"]).lag({"_p": ("seq", 1)})
    scan = scan.running({"first": (F.max, F.when(F.col("_p").isNull() | (F.col("seq") - F.col("_p") != 1), F.col("seq")))})
    placed = good.join(scan.frame().select("folder", "seq", "first"), ["folder", "seq"]).join(spans, ["folder", "first"])
    names = F.create_map(*[F.lit(v) for kv in DDL_CLASSES.items() for v in kv])
    padded = [F.lpad(F.col(c).cast("string"), 6, "0") for c in ("first", "last")]
    placed = sound_source(audio_columns(placed), F.lit(True)).withColumns({
        "capture_id": under(ds, "folder", F.concat_ws("-", *padded)), "group_id": under(ds, "folder"), "part_index": F.col("seq") - F.col("first"),
        "_class": F.coalesce(names[F.col("d.class_code")], F.col("d.class_code")), "recorded_at": iso_timestamp(F.col("d.recorded"), "yyyyMMddHHmmss")})
    classes = profiles.distinct_text(placed, ["capture_id"], "_class").select("capture_id", F.replace("values", F.lit("; "), F.lit(" / ")).alias("label_class"))
    placed = placed.join(classes, "capture_id")
    rest = rows.where(~F.coalesce(usable, F.lit(False))).withColumns({"capture_id": F.lit(None).cast("string"), "group_id": F.lit(None).cast("string")})
    both = placed.unionByName(rest, allowMissingColumns=True)
    empty = rest.where(F.col("d.matched"))
    return assemble(ds, both, "audio/wav", "class code in the file name", ("segment", "one recording segment of one flight day", "AUTHOR_DOC"), channels=wav_channel_names(),
                    extra_evidence=[wav_formats(ds, placed), count_evidence(ds, "clips_in_captures", good, "WAV headers"), count_evidence(ds, "empty_clips_without_capture", empty, "WAV headers"),
                                    count_evidence(ds, "unparseable_names_without_capture", rest.where(~F.col("d.matched")), "file name format")],
                    problems=[unexpected(good, F.coalesce(F.col("wav.data_bytes"), F.lit(0)) == 0, "no readable data")])


# ------------------------------------------------------------------ radio
# Digits of the file name; published segment counts
DRONERF_MODELS = {"00": "Parrot Bebop", "01": "Parrot AR Drone", "10": "DJI Phantom 3"}
DRONERF_MODES = {"00": "on_connected", "01": "hovering", "10": "flying", "11": "flying_video"}
DRONERF_FOLDERS = {"Bepop drone": "Parrot Bebop", "AR drone": "Parrot AR Drone", "Phantom drone": "DJI Phantom 3", "Background RF activites": "background"}
DRONERF_PUBLISHED = {"background": 41, "Parrot Bebop": 84, "Parrot AR Drone": 81, "DJI Phantom 3": 21}


def dronerf(members: DataFrame, loose: DataFrame | None = None, containers: DataFrame | None = None) -> Tables:
    """CSV members of nested archives: member_chain = [inner archive, member]. Low and high band of one segment are one
    capture. loose / containers (path, size_bytes, crc32): stray archives and the members of the main one."""
    ds = "dronerf"
    inner = F.replace(F.element_at("member_chain", -1), F.lit("\\"), F.lit("/"))
    outer = F.element_at("member_chain", 1)
    rows = members.withColumn("n", G.decode(file_name(inner), "dronerf_csv"))
    digits = F.col("n.bui")
    present = F.substring(digits, 1, 1) == "1"
    models, modes = G.lookup(F.substring(digits, 2, 2), DRONERF_MODELS), G.lookup(F.substring(digits, 4, 2), DRONERF_MODES)
    rows = rows.withColumns({
        "artifact_id": under(ds, outer, inner), "capture_id": F.when(F.col("n.matched"), under(ds, digits, F.concat(F.lit("segment_"), F.col("n.segment").cast("string")))),
        "group_id": F.when(F.col("n.matched"), under(ds, digits)), "channel": F.col("n.band"), "label_uas_present": present,
        "label_emitter": F.when(present, "uas_link").otherwise("none"), "label_class": F.when(present, models), "label_condition": F.when(present, modes),
        "_named": F.when(present, models).otherwise("background"), "_folder": G.lookup(F.split(outer, "/")[1], DRONERF_FOLDERS), "_segment": F.col("n.segment")})
    named = rows.where(F.col("n.matched"))
    spark = members.sparkSession
    published = spark.createDataFrame(list(DRONERF_PUBLISHED.items()), "model string, n long")
    found = named.select("_named", "capture_id").distinct().groupBy(F.col("_named").alias("model")).agg(F.count("*").alias("n"))
    versus = catalog.published_counts(published, found, "model").select(
        F.lit(ds).alias("entity_id"), F.concat(F.lit("segments["), F.col("entity_id"), F.lit("]")).alias("field"), "value", "status", F.lit("listing and paper").alias("source"), F.lit(None).cast("long").alias("n"))
    numbers = sequences.consecutive_check(named, ["group_id"], "_segment", 0)
    sizes = named.agg(F.min("size_bytes").alias("lo"), F.max("size_bytes").alias("hi"), F.count("*").alias("n"))
    lineage = []
    if loose is not None and containers is not None:
        copies = exact_copies(loose, containers, ["size_bytes", "crc32"], "path", "path", "size and CRC32")
        lineage.append(copies.withColumns({"object": F.coalesce("object", F.lit("")), "status": F.when(F.col("relation") == "unmatched", "UNKNOWN").otherwise("VERIFIED")}))
    return assemble(ds, rows, "text/csv", "digits in the file name", ("bui_recording", "segments are consecutive cuts of one recording", "INFERRED"),
                    lineage=lineage, extra_evidence=[versus, numbers.select(*evidence(F.col("group_id"), "segments", F.col("n"), "VERIFIED", "listing", F.col("n"))),
                                                     sizes.select(*evidence(F.lit(ds), "csv_size_bytes_min", F.col("lo"), "VERIFIED", "listing", F.col("n"))),
                                                     sizes.select(*evidence(F.lit(ds), "csv_size_bytes_max", F.col("hi"), "VERIFIED", "listing", F.col("n")))],
                    problems=[unexpected(rows, ~F.col("n.matched"), "unexpected member"), unexpected(named, F.col("_folder").isNull(), "unexpected folder"),
                              catalog.name_disagreement(named.where(F.col("_folder").isNotNull()), "_named", "_folder", "artifact_id"),
                              catalog.pair_completeness(named, ["capture_id"], "channel", ["L", "H"]),
                              catalog.problem(numbers.where(~F.col("complete")), "segment numbers are not consecutive from 0", "group_id")])


def cardrf(members: DataFrame) -> Tables:
    """One triggered capture per member. meta (frame fields): date, model, serial, num_points, x_inc. Aircraft and
    controller of a system are one group."""
    ds, hour = "cardrf", 3600
    kept = members.where(F.col("path").like("%.mat") & ~F.col("path").contains("__MACOSX"))
    rows = kept.withColumn("p", G.transmission_path(F.col("path")))
    uas = F.col("p.category").isin("UAV", "UAV_Controller")
    rows = rows.withColumns({
        "artifact_id": under(ds, "path"), "capture_id": F.when(F.col("p.valid"), under(ds, without("path", ".mat"))),
        "group_id": F.when(uas, under(ds, F.lit("UAS"), "p.device")).otherwise(under(ds, "p.category", "p.device")),
        "recorded_at": iso_timestamp(meta("date"), "d-MMM-yyyy H:mm:ss"), "duration_s": meta("num_points", "double") * meta("x_inc", "double"),
        "sample_rate_hz": 1 / meta("x_inc", "double"), "official_split": F.col("p.split"), "label_uas_present": uas,
        "label_emitter": G.lookup(F.col("p.category"), G.PATH_EMITTERS), "label_class": F.col("p.device"), "label_condition": F.concat_ws("/", "p.sight", "p.mode")})
    stamps = rows.where(F.col("p.valid")).withColumn("_ts", F.to_timestamp_ntz("recorded_at", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    found = sequences.time_blocks(stamps, ["group_id"], "_ts", "artifact_id", hour)
    text = F.concat(F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" → "), F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    blocks = (found.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", text.alias("t")))), lambda s: s["t"]), "; ").alias("v"), F.sum("n").alias("n"))
              .select(*evidence(F.col("group_id"), "recording_blocks", F.col("v"), "VERIFIED", "date of every capture", F.col("n"))))

    def values(field: str, value: Column) -> DataFrame:
        t = profiles.distinct_text(stamps.select(F.lit(ds).alias("ds"), value.cast("string").alias("v")), ["ds"], "v")
        return t.select(*evidence(F.col("ds"), field, F.col("values"), "VERIFIED", "frame fields of every capture"))
    derived = members.sparkSession.createDataFrame([("cardrf/original/Processed_CardRF.zip", "derived_from", "cardrf/original/CARDRF.zip", "slices of the line-of-sight captures", "EMPIRICAL")], LINEAGE)
    kind = F.when(F.col("group_id").contains("/UAS/"), "uas_system").otherwise("device")
    return assemble(ds, rows, "application/x-matlab-data", "release folders", (kind, "one physical unit per model; a system's aircraft and controller together", "INFERRED"),
                    channels=F.array().cast("array<string>"), lineage=[derived],
                    extra_evidence=[blocks, values("sample_rate_hz_values", F.bround(F.col("sample_rate_hz")).cast("long")), values("num_points_values", meta("num_points")),
                                    values("instrument", F.concat_ws(" ", meta("model"), meta("serial"))),
                                    count_evidence(ds, "macosx_junk_entries_skipped", members.where(F.col("path").contains("__MACOSX")), "member listing")],
                    problems=[unexpected(rows, ~F.col("p.valid"), "unexpected path"), unexpected(rows, F.col("recorded_at").isNull(), "unreadable date")])


# Fixed values
UAVSIG_RATE_HZ, UAVSIG_CENTRE_HZ = 50e6, 2.4435e9


def uavsig(members: DataFrame, official: DataFrame) -> Tables:
    """1 s captures. meta: samples, transmissions, created. official (path, size_bytes): the repository's listing."""
    ds = "uavsig"
    rows = members.withColumns({"d": G.decode(file_name(), "uavsig_drone"), "c": G.decode(file_name(), "uavsig_controller")})
    drone, controller = F.col("d.matched"), F.col("c.matched")
    code = F.coalesce("d.code", "c.code")
    active = F.regexp_replace(code, "0", "") != ""
    listed = official.select("path", F.col("size_bytes").alias("_listed"))
    rows = rows.join(listed, "path", "left").withColumns({
        "artifact_id": under(ds, "path"), "capture_id": F.when(drone | controller, under(ds, without("path", ".mat"))),
        "group_id": F.when(drone | controller, under(ds, F.split("path", "/")[0], F.regexp_replace(file_name(), "_[^_]*$", ""))),
        "duration_s": meta("samples", "double") / UAVSIG_RATE_HZ, "sample_rate_hz": F.lit(UAVSIG_RATE_HZ), "center_frequency_hz": F.lit(UAVSIG_CENTRE_HZ), "label_uas_present": active,
        "label_emitter": F.when(~active, "none").when(drone, "aircraft").otherwise("controller"),
        "label_class": F.when(drone, G.active_set(F.col("d.code"), "drone")).otherwise(G.active_set(F.col("c.code"), "controller")),
        "label_condition": F.when(drone, G.channel_set(F.col("d.code"), "drone")).otherwise(F.concat(F.lit("arrangement p"), F.col("c.arrangement")))})
    same = F.col("size_bytes").eqNullSafe(F.col("_listed"))
    lineage = rows.select(F.col("storage_relpath").alias("subject"), F.when(same, "local_copy_of").otherwise("unmatched").alias("relation"),
                          F.concat(F.lit("doi:10.25346/S6/LVRRAE/"), F.col("path")).alias("object"), F.lit("size equals the listing").alias("method"),
                          F.when(same, "VERIFIED").otherwise("UNKNOWN").alias("status"))
    released = official.where(F.col("path").like("%.mat")).groupBy(F.split("path", "/")[0].alias("k")).agg(F.count("*").alias("all"))
    local = rows.where(F.col("capture_id").isNotNull()).groupBy(F.split("path", "/")[0].alias("k")).agg(F.count("*").alias("here"))
    part = F.concat(F.col("k"), F.lit(": "), F.coalesce("here", F.lit(0)).cast("string"), F.lit(" of "), F.col("all").cast("string"))
    subset = released.join(local, "k", "left").agg(F.array_join(F.array_sort(F.collect_list(part)), "; ").alias("v")).select(*evidence(F.lit(ds), "local_subset", F.col("v"), "VERIFIED", "files and listing"))
    made = rows.select(F.to_timestamp_ntz(strip_weekday(F.regexp_replace(meta("created"), r"\s+", " ")), F.lit("MMM d HH:mm:ss yyyy")).alias("t")).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return assemble(ds, rows, "application/x-matlab-data", "file name", ("scenario", "one transmitter set and arrangement, consecutive captures", "AUTHOR_DOC"),
                    channels=F.array().cast("array<string>"), lineage=[lineage],
                    extra_evidence=[subset, made.select(*evidence(F.lit(ds), "mat_header_created", F.concat_ws(" … ", F.col("a").cast("string"), F.col("b").cast("string")), "VERIFIED", "MAT headers")),
                                    rows.select(*evidence(F.col("capture_id"), "labelled_transmissions", meta("transmissions"), "VERIFIED", "num_transmission")),
                                    count_evidence(ds, "baseline_captures", rows.where(~F.col("label_uas_present")), "file names")],
                    problems=[unexpected(rows, ~(drone | controller), "name does not follow the format"), unexpected(rows, ~same, "not in the listing or size differs")])


# Fixed values
NOISY_RATE_HZ, NOISY_CENTRE_HZ, NOISY_SAMPLES = 14e6, 2.44175e9, 16384


def noisy_rf(members: DataFrame, vectors: DataFrame, class_counts: DataFrame, snr_counts: DataFrame) -> Tables:
    """One stored tensor holds all captures. vectors (index, class, snr, duty); *_counts: the release's own tables
    (class, n) and (snr, n). Without recording ids everything is one group."""
    ds, tensor, group = "noisy_rf", "noisy_rf/archive.zip/dataset.pt", "noisy_rf/all"
    artifacts = members.where(file_name() == "dataset.pt").select(
        F.lit(tensor).alias("artifact_id"), F.lit(ds).alias("dataset_id"), "storage_relpath", "member_chain", "size_bytes", F.lower("crc32").alias("crc32"), F.col("mtime").alias("member_mtime"),
        F.lit("application/x-pytorch").alias("media_type"), F.lit(None).cast("string").alias("capture_id"), F.lit(None).cast("string").alias("channel"), F.lit(None).cast("int").alias("part_index"))
    noise = F.col("class") == "Noise"
    values = {"capture_id": F.concat(F.lit(f"{ds}/dataset.pt/"), F.col("index").cast("string")), "dataset_id": F.lit(ds), "group_id": F.lit(group), "n_artifacts": F.lit(0), "stored_in": F.lit(tensor),
              "stored_index": F.col("index"), "channels": F.array(F.lit("I"), F.lit("Q")), "duration_s": F.lit(NOISY_SAMPLES / NOISY_RATE_HZ), "center_frequency_hz": F.lit(NOISY_CENTRE_HZ),
              "sample_rate_hz": F.lit(NOISY_RATE_HZ), "reference_snr_db": F.col("snr"), "label_uas_present": ~noise, "label_emitter": F.when(noise, "none").otherwise("controller"),
              "label_class": F.col("class"), "label_source": F.lit("label tensor and class table"), "label_status": F.lit("REPO_METADATA")}
    captures = vectors.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INDEX["captures"]])
    groups = catalog.groups_from(captures, "no_recording_ids", "vectors carry no recording id, so no split inside is leakage-safe", "UNKNOWN")
    lineage = members.sparkSession.createDataFrame([("interim/noisy_rf/extracted/dataset.pt", "exact_copy_of", "noisy_rf/original/archive.zip::dataset.pt", "CRC32 on extraction", "VERIFIED")], LINEAGE)
    evidences, problems = [], []
    for field, expected, key in (("class_counts", class_counts, "class"), ("snr_counts", snr_counts, "snr")):
        found = vectors.groupBy(F.col(key)).agg(F.count("*").alias("n"))
        check = catalog.published_counts(expected, found, key)
        evidences.append(check.select(F.lit(ds).alias("entity_id"), F.concat(F.lit(f"{field}["), F.col("entity_id"), F.lit("]")).alias("field"), "value", "status", F.lit("tensor and release table").alias("source"), F.lit(None).cast("long").alias("n")))
        problems.append(catalog.problem(check.where(F.col("status") == "CONFLICTING"), f"{field} differ from the release table", "entity_id", F.col("value")))
    span = vectors.agg(F.min("duty").alias("a"), F.max("duty").alias("b"), F.count("*").alias("n"))
    evidences.append(span.select(*evidence(F.lit(ds), "duty_cycle_range", F.format_string("%.4f – %.4f", F.col("a").cast("double"), F.col("b").cast("double")), "VERIFIED", "duty_cycle tensor", F.col("n"))))
    return finish(ds, artifacts, captures, groups, [lineage], evidences, problems)


# Subset folders and their short names; files stored twice; fields kept as evidence
DRFF_SUBSETS = {"dataset1-single_drone_states": "single_drone_states", "dataset2-drone_mixed": "drone_mixed", "dataset3-single_drone_hover": "single_drone_hover",
                "dataset4-single_drone_dual_frequency": "dual_frequency", "dataset5-single_drone_inside_absorbent_cotton": "absorbent_cotton", "dataset6-wifi_mixed": "wifi_mixed",
                "dataset7-environment": "environment"}
DRFF_RELEASE, DRFF_COPIES, DRFF_SAMPLES = "DRFF-R2/", "DRFF-R2/dataset5-single_drone_inside_absorbent_cotton/dataset7-environment/", 140_000_000
DRFF_FIELDS = ["U", "D", "C", "Height", "V", "Distance", "Direction", "Near", "State"]


def drff_r2(members: DataFrame) -> Tables:
    """One 1.4 s capture per file. meta: the file's scalar fields. Files outside the release folder and the nested copy of
    the environment subset are lineage only. sha256 required."""
    ds = "drff_r2"
    inside = F.startswith("path", F.lit(DRFF_RELEASE)) & ~F.startswith("path", F.lit(DRFF_COPIES))
    released = members.where(inside)
    # files of one content inside the release are indexed once, under the last name
    last = released.groupBy("sha256").agg(F.max("path").alias("path"))
    rows = released.join(last.select("path"), "path", "left_semi").withColumn("tag", G.lookup(F.split("path", "/")[1], DRFF_SUBSETS))
    tag, td = F.col("tag"), meta("TD")
    env = tag == "environment"
    units = F.filter(F.array(td, meta("NTD1"), meta("NTD2")), lambda u: u.isNotNull() & ~u.isin("", "none"))
    rate = meta("Fs", "double")
    rows = rows.withColumns({
        "artifact_id": under(ds, "path"), "capture_id": F.when(tag.isNotNull(), under(ds, without(F.substring("path", len(DRFF_RELEASE) + 1, 10000), ".mat"))),
        "group_id": F.when(env, under(ds, F.lit("environment"), without(file_name(), ".mat"))).when(tag == "drone_mixed", under(ds, F.lit("drone_mixed"), F.split("path", "/")[2]))
                     .when(tag == "wifi_mixed", under(ds, F.lit("wifi_mixed"), td)).otherwise(under(ds, td, meta("D"))),
        "duration_s": DRFF_SAMPLES / rate, "sample_rate_hz": rate, "center_frequency_hz": first_filled(meta("CenterFrequence"), meta("CenterFreq")).try_cast("double"),
        "label_uas_present": ~env, "label_emitter": F.when(env, "none").otherwise("uas_link"), "label_class": F.when(~env, F.array_join(units, "+")),
        "label_condition": F.when(~env & (F.coalesce(meta("State"), F.lit("")) != ""), F.concat_ws("/", tag, meta("State"))).otherwise(tag)})
    fields = F.filter(F.array(*[F.struct(F.lit(f).alias("f"), meta(f).alias("v")) for f in DRFF_FIELDS]), lambda s: s["v"].isNotNull())
    kept = rows.where(tag.isNotNull()).select("capture_id", F.explode(fields).alias("e")).select(*evidence(F.col("capture_id"), F.concat(F.lit("mat."), F.col("e.f")), F.col("e.v"), "VERIFIED", "scalar field"))
    conflict = rows.where(env & (F.coalesce(td, F.lit("")) != "")).select(*evidence(F.col("capture_id"), "environment_file_metadata", F.concat(F.lit("folder says environment, fields say TD="), td), "CONFLICTING", "fields and folder"))
    copies = exact_copies(members.where(~inside), rows, ["sha256"], "storage_relpath", "storage_relpath", "equal SHA-256").withColumns(
        {"object": F.coalesce("object", F.lit("")), "status": F.when(F.col("relation") == "unmatched", "UNKNOWN").otherwise("VERIFIED")})
    second = F.split("group_id", "/")[1]
    kind = F.when(second.isin("environment", "drone_mixed", "wifi_mixed"), second).otherwise("unit_day")
    basis = F.when(kind == "unit_day", "one unit on one day, all subsets and receivers").when(kind == "drone_mixed", "one mixture folder").when(kind == "wifi_mixed", "one unit in the Wi-Fi subset").otherwise("one environment recording")
    return assemble(ds, rows, "application/x-matlab-data", "subset folder and file fields", (kind, basis, "INFERRED"), channels=F.array().cast("array<string>"), lineage=[copies],
                    extra_evidence=[kept, conflict, count_evidence(ds, "files_indexed", rows, "release folder minus copies"), count_evidence(ds, "copies_not_indexed", members.where(~inside), "equal SHA-256")],
                    problems=[unexpected(rows, tag.isNull(), "unexpected subset"), unexpected(rows, rate.isNull(), "no sample rate")])


# Fixed values
RFUAV_SAMPLE_BYTES = 8
RFUAV_FIELDS = ["SerialNumber", "Drone", "ScaleFactor", "ReferenceSNRLevel", "CenterFrequency", "SampleRate", "IFBandwidth", "DataType", "DeviceType", "SampleCount"]


def rfuav(members: DataFrame, official: DataFrame) -> Tables:
    """1 s chunks of packs; a gap-free run of chunks is one capture. XML members carry their fields in meta.
    official (storage_relpath, official, sha256, local_sha256): archive names and checksums."""
    ds = "rfuav"
    local = official.select("storage_relpath", "official", F.col("sha256").eqNullSafe(F.col("local_sha256")).alias("_same"))
    rows = members.join(local, "storage_relpath", "left").withColumns(
        {"inner": F.replace("path", F.lit("\\"), F.lit("/")), "q": G.decode(file_name(F.replace("path", F.lit("\\"), F.lit("/"))), "rfuav_iq"),
         "x": G.decode(file_name(F.replace("path", F.lit("\\"), F.lit("/"))), "rfuav_xml")}).withColumn("folder", folder("inner"))
    xml = rows.where(F.col("x.matched")).select("folder", F.col("x.pack").alias("xml_pack"), F.col("meta").alias("xml"), F.col("inner").alias("xml_member"))
    iq = rows.where(F.col("q.matched")).withColumns({"pack": F.col("q.pack"), "seq": F.col("q.start")})
    packs = iq.select("folder", "pack").distinct()
    direct = packs.join(xml, (packs["folder"] == xml["folder"]) & (packs["pack"] == xml["xml_pack"])).select(packs["folder"], "pack", "xml_pack", "xml", "xml_member")
    # the folder's only XML may describe its only pack although the numbers differ
    lone_x = xml.groupBy("folder").agg(F.count("*").alias("nx"), F.max_by(F.struct("xml_pack", "xml", "xml_member"), "xml_pack").alias("o")).where("nx = 1")
    lone_p = packs.groupBy("folder").agg(F.count("*").alias("np"), F.max("pack").alias("pack")).where("np = 1")
    swapped = (lone_p.join(direct.select("folder", "pack"), ["folder", "pack"], "left_anti").join(lone_x, "folder").select("folder", "pack", "o.xml_pack", "o.xml", "o.xml_member"))
    linked = direct.unionByName(swapped).withColumn("group_id", under(ds, "folder", F.concat(F.lit("pack"), F.col("pack").cast("string"))))
    spans = sequences.runs(iq, ["folder", "pack"], "seq")
    scan = sequences.ordered(iq.select("folder", "pack", "seq").distinct(), ["folder", "pack"], ["seq"]).lag({"_p": ("seq", 1)})
    scan = scan.running({"first": (F.max, F.when(F.col("_p").isNull() | (F.col("seq") - F.col("_p") != 1), F.col("seq")))})
    keys = ["folder", "pack"]
    placed = (iq.join(scan.frame().select(*keys, "seq", "first"), [*keys, "seq"]).join(spans.select(*keys, "first", "last"), [*keys, "first"]).join(linked, keys, "left"))
    number = F.col("xml")
    klass = F.split("folder", "/")[0]
    placed = placed.withColumns({
        "artifact_id": under(ds, "official", "inner"), "group_id": under(ds, "folder", F.concat(F.lit("pack"), F.col("pack").cast("string"))), "part_index": F.col("seq") - F.col("first"),
        "capture_id": under(ds, "folder", F.format_string("pack%d_%d-%ds", F.col("pack"), F.col("first"), F.col("last") + 1)), "start_s": F.col("first").cast("double"),
        "duration_s": F.col("size_bytes") / RFUAV_SAMPLE_BYTES / number["SampleRate"].try_cast("double"), "sample_rate_hz": number["SampleRate"].try_cast("double"),
        "center_frequency_hz": number["CenterFrequency"].try_cast("double"), "reference_snr_db": number["ReferenceSNRLevel"].try_cast("double"), "label_uas_present": F.lit(True),
        "label_class": klass, "label_condition": F.get(F.split("folder", "/"), F.lit(1))})
    said = F.filter(F.array(*[F.struct(F.lit(f).alias("f"), F.col("xml")[f].alias("v")) for f in RFUAV_FIELDS]), lambda s: s["v"].isNotNull())
    fields = linked.select("group_id", F.explode(said).alias("e")).select(*evidence(F.col("group_id"), F.concat(F.lit("xml."), F.col("e.f")), F.col("e.v"), "AUTHOR_DOC", "pack XML"))
    link = linked.where(F.col("pack") != F.col("xml_pack")).select(*evidence(F.col("group_id"), "xml_link", F.format_string("pack%d.xml describes pack%d", F.col("xml_pack"), F.col("pack")), "CONFLICTING", "only XML of the folder"))

    def plain(c: Column) -> Column:
        return F.upper(F.replace(c, F.lit(" "), F.lit("")))
    label = linked.where(plain(F.col("xml")["Drone"]) != plain(klass)).select(*evidence(F.col("group_id"), "label_disagreement", F.concat(klass, F.lit(" vs "), F.col("xml")["Drone"]), "CONFLICTING", "folder and XML"))
    holes = (sequences.missing_numbers(iq.join(spans.groupBy(*keys).count().where("count > 1").select(*keys), keys, "left_semi"), keys, "seq", 0).groupBy(*keys)
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list("missing")), lambda m: F.concat(m.cast("string"), F.lit("-"), (m + 1).cast("string"), F.lit("s"))), ", ").alias("v"))
             .select(*evidence(under(ds, "folder", F.concat(F.lit("pack"), F.col("pack").cast("string"))), "missing_chunks_s", F.col("v"), "VERIFIED", "chunk numbers")))
    serial = linked.select(F.col("xml")["SerialNumber"].alias("serial"), "group_id")
    shared = profiles.shared_values(serial, "serial", "group_id").select("serial")
    twice = (serial.join(shared, "serial", "left_semi").groupBy("serial").agg(F.array_join(F.array_sort(F.collect_set("group_id")), "; ").alias("g"))
             .select(*evidence(F.lit(ds), "duplicate_xml_serial", F.concat_ws(": ", "serial", "g"), "VERIFIED", "pack XMLs")))
    lineage = local.select(F.col("storage_relpath").alias("subject"), F.when(F.col("_same"), "local_copy_of").otherwise("unmatched").alias("relation"),
                           F.concat(F.lit("huggingface:kitofrank/RFUAV/"), F.col("official")).alias("object"), F.lit("equal SHA-256").alias("method"), F.when(F.col("_same"), "VERIFIED").otherwise("UNKNOWN").alias("status"))
    bare = placed.where(F.col("xml").isNull()).select("group_id").distinct()
    return assemble(ds, placed, "application/octet-stream", "class folder", ("pack", "chunks are consecutive cuts of one recording", "INFERRED"), channels=F.array().cast("array<string>"), lineage=[lineage],
                    extra_evidence=[fields, link, label, holes, twice],
                    problems=[unexpected(rows, ~(F.col("q.matched") | F.col("x.matched")), "unexpected member"), unexpected(rows, F.col("official").isNull(), "unknown archive"),
                              unexpected(iq, F.col("q.end") != F.col("q.start") + 1, "chunk is not one second"), unexpected(iq, F.col("size_bytes") % RFUAV_SAMPLE_BYTES != 0, "not a whole number of samples"),
                              unexpected(iq, without("official", ".rar") != klass, "class folder differs from the archive name"), catalog.problem(bare, "no XML for this pack", "group_id")])


# Archive -> system, link, emitter
RMA_ARCHIVES = [("Spektrum_DX4e", "Spektrum DX4e", None, "controller"), ("Frysky", "Frysky", None, "controller"), ("NineEagles", "NineEagles", None, "controller"),
                ("wltoys", "wltoys", None, "controller"), ("Q205", "Q205", None, "controller"), ("SJRC_pro", "SJRC F11 Pro", None, None), ("mini2RC", "DJI Mini 2", "RC", "controller"),
                ("mini2vid", "DJI Mini 2", "Vid", "aircraft"), ("inspire2RC", "DJI Inspire 2", "RC", "controller"), ("inspire2Vid", "DJI Inspire 2", "Vid", "aircraft"),
                ("matriceRC", "DJI Matrice", "RC", "controller"), ("matricevid", "DJI Matrice", "Vid", "aircraft"), ("MavicRC1", "Mavic", "RC", "controller"),
                ("MavicRC2", "Mavic", "RC", "controller"), ("MavicVid1", "Mavic", "Vid", "aircraft"), ("MavicVid2", "Mavic", "Vid", "aircraft")]
RMA_RATE_HZ, RMA_CENTRE_HZ = 100e6, 2.44e9


def rma(members: DataFrame, official: DataFrame, loose: DataFrame | None = None) -> Tables:
    """One archive per system and link. meta: created, samples. official (path, size_bytes, local_size): archive sizes."""
    ds = "rma"
    table = members.sparkSession.createDataFrame(RMA_ARCHIVES, "archive string, system string, link string, emitter string")
    rows = members.withColumn("archive", without(file_name("storage_relpath"), ".zip")).join(F.broadcast(table), "archive", "left")      # 16 archives
    created = F.to_timestamp_ntz(strip_weekday(F.regexp_replace(meta("created"), r"\s+", " ")), F.lit("MMM d HH:mm:ss yyyy"))
    rows = rows.withColumns({
        "artifact_id": under(ds, file_name("storage_relpath"), "path"), "capture_id": F.when(F.col("system").isNotNull() & F.col("path").like("%.mat"), under(ds, "archive", without(file_name(), ".mat"))),
        "group_id": under(ds, "archive"), "_ts": created, "recorded_at": F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss"), "duration_s": meta("samples", "double") / RMA_RATE_HZ,
        "sample_rate_hz": F.lit(RMA_RATE_HZ), "center_frequency_hz": F.lit(RMA_CENTRE_HZ), "label_uas_present": F.lit(True), "label_emitter": F.col("emitter"), "label_class": F.col("system"),
        "label_condition": F.col("link")})
    good = rows.where(F.col("capture_id").isNotNull())
    span = good.groupBy("group_id").agg(F.min("_ts").alias("a"), F.max("_ts").alias("b"), F.count("*").alias("n"))
    lengths = profiles.distinct_text(good.withColumn("s", meta("samples")), ["group_id"], "s")
    same = F.col("size_bytes").eqNullSafe(F.col("local_size"))
    lineage = [official.select(F.col("path").alias("subject"), F.when(same, "local_copy_of").otherwise("unmatched").alias("relation"), F.concat(F.lit("doi:10.48804/HZRVNZ/"), file_name()).alias("object"),
                               F.lit("size equals the repository record").alias("method"), F.when(same, "VERIFIED").otherwise("UNKNOWN").alias("status"))]
    if loose is not None:
        inside = good.withColumn("_o", F.concat_ws("::", "storage_relpath", "path"))
        lineage.append(exact_copies(loose, inside, ["size_bytes", "crc32"], "path", "_o", "size and CRC32").withColumns(
            {"object": F.coalesce("object", F.lit("")), "status": F.when(F.col("relation") == "unmatched", "UNKNOWN").otherwise("VERIFIED")}))
    return assemble(ds, rows, "application/x-matlab-data", "archive name", ("archive", "one archive is one recording session", "INFERRED"), channels=F.array().cast("array<string>"), lineage=lineage,
                    extra_evidence=[span.select(*evidence(F.col("group_id"), "created_span", F.concat_ws(" → ", F.col("a").cast("string"), F.col("b").cast("string")), "VERIFIED", "file headers", F.col("n"))),
                                    lengths.select(*evidence(F.col("group_id"), "samples_per_file", F.replace("values", F.lit("; "), F.lit(", ")), "VERIFIED", "array shapes"))],
                    problems=[unexpected(rows, F.col("system").isNull(), "unexpected archive"), unexpected(rows, ~F.col("path").like("%.mat"), "unexpected member")])


BUILDERS: dict[str, Callable[..., Tables]] = {f.__name__: f for f in (esc50, svanstrom, uavirbase, dronenoise, miesikowska_uav, ddl, dronerf, cardrf, uavsig, noisy_rf, drff_r2, rfuav, rma)}
