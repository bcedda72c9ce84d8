"""File names, paths and digit strings to typed columns. Unmatched names give ``matched = false`` and NULL fields."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name formats of the public releases, with the names of their fields
NAME_FORMATS = {
    "dronerf_csv": (r"^([01]{5})([LH])_(\d+)\.csv$", ["bui", "band", "segment:int"]),
    "rfuav_iq": (r"^pack(\d+)_(\d+)-(\d+)s\.iq$", ["pack:int", "start:int", "end:int"]),
    "rfuav_xml": (r"^pack(\d+)\.xml$", ["pack:int"]),
    "uavsig_drone": (r"^drone_([0-4]{4})_(\d{2})\.mat$", ["code", "take"]),
    "uavsig_controller": (r"^controller_p(\d)_([01]{4})_(\d{2})\.mat$", ["arrangement", "code", "take"]),
    "dronenoise_event": (r"^(?:(\d+)_)?Ed_(\w+?)_(\d+)_([FH]\d\d)_(.+)_ev(\d)_M(\d)\.wav$",
                         ["file_number", "drone", "height", "operation", "rest", "event", "mic:int"]),
    "dronenoise_calibration": (r"^Calib_Scotland_ch(\d)\.wav$", ["channel"]),
    "miesikowska": (r"(?i)^x4_(d\d+)_([a-z0-9]+)_(\d+)m_(\d+)m_(\d{6})_(\d+)(.*)\.wav$",
                    ["drone", "model", "altitude", "offset", "date", "take", "rest"]),
    "ddl": (r"^(\d{14})([A-Z0-9]{4})(\d{3})(\d{3})(\d{3})(\d{4})([RS])(\d{6})-(T\d{3})-(\d{6})\.wav$",
            ["recorded", "class_code", "bearing:int", "range_m:int", "altitude:int", "temperature:int", "direction", "session", "segment", "seq:int"]),
    "url": (r"^(https?)://([^/]+)/([a-z]{2})/(\d+)", ["scheme", "host", "language", "number:int"]),
}
# Path parts of CardRF
PATH_EMITTERS = {"UAV": "aircraft", "UAV_Controller": "controller", "WIFI": "wifi", "BLUETOOTH": "bluetooth"}
PATH_SPLITS = ["Train", "Test"]


def decode(name: Column, fmt: str) -> Column:
    """Struct of the fields of one name format plus ``matched``."""
    pattern, fields = NAME_FORMATS[fmt]
    matched = F.coalesce(name.rlike(pattern), F.lit(False))
    out = [matched.alias("matched")]
    for i, field in enumerate(fields, 1):
        label, _, kind = field.partition(":")
        value = F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
        out.append(F.when(matched, value.try_cast(kind) if kind else value).alias(label))
    return F.struct(*out)


def url_page(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"[?&]page=(\d+)", 1), F.lit("")).try_cast("int")


def transmission_path(path: Column) -> Column:
    """``root/sight/[Train|Test/]category/device[/mode]/file``: struct(sight, split, category, device, mode, valid).

    An absent split shifts the rest to the left; an unknown category or an extra folder is not valid.
    """
    parts = F.split(path, "/")
    has_split = F.coalesce(F.get(parts, F.lit(2)).isin(PATH_SPLITS), F.lit(False))
    base = F.lit(2) + has_split.cast("int")
    category, folders = F.get(parts, base), F.size(parts) - 1 - base
    known = F.coalesce(category.isin(list(PATH_EMITTERS)), F.lit(False))
    return F.struct(F.get(parts, F.lit(1)).alias("sight"), F.when(has_split, F.lower(F.get(parts, F.lit(2)))).alias("split"), category.alias("category"),
                    F.when(folders >= 2, F.get(parts, base + 1)).alias("device"), F.when(folders >= 3, F.get(parts, base + 2)).alias("mode"),
                    (known & folders.between(2, 3)).alias("valid"))


def active_set(code: Column, name: str) -> Column:
    """Digit string, one digit per transmitter giving its channel, 0 = off: ``drone_1+drone_2``; NULL if all are off."""
    on = F.filter(F.transform(F.split(code, ""), lambda c, i: F.when(c.rlike("^[1-9]$"), F.concat(F.lit(name + "_"), (i + 1).cast("string")))), lambda v: v.isNotNull())
    return F.nullif(F.array_join(on, "+"), F.lit(""))


def channel_set(code: Column, name: str) -> Column:
    """The same digits as ``drone_1:ch1, drone_2:ch2``."""
    on = F.filter(F.transform(F.split(code, ""), lambda c, i: F.when(c.rlike("^[1-9]$"), F.concat(F.lit(name + "_"), (i + 1).cast("string"), F.lit(":ch"), c))), lambda v: v.isNotNull())
    return F.nullif(F.array_join(on, ", "), F.lit(""))


def lookup(code: Column, table: dict[str, str]) -> Column:
    """Code to label through a literal map; for small code lists."""
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[code]
