"""Fixed table layouts. Relations, statuses and kinds are fixed values."""
from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_STRINGS, _FLOATS = T.ArrayType(T.StringType()), T.ArrayType(T.FloatType())


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ARTIFACTS = _table(artifact_id=_S, dataset_id=_S, storage_relpath=_S, member_chain=_STRINGS, size_bytes=_L, crc32=_S,
                   member_mtime=_S, media_type=_S, capture_id=_S, channel=_S, part_index=_I)
CAPTURES = _table(capture_id=_S, dataset_id=_S, group_id=_S, n_artifacts=_I, stored_in=_S, stored_index=_L, channels=_STRINGS,
                  recorded_at=_S, start_s=_D, duration_s=_D, center_frequency_hz=_D, sample_rate_hz=_D, reference_snr_db=_D,
                  official_split=_S, label_uas_present=_B, label_emitter=_S, label_class=_S, label_condition=_S,
                  label_source=_S, label_status=_S)
GROUPS = _table(group_id=_S, dataset_id=_S, kind=_S, basis=_S, status=_S, n_captures=_I)
LINEAGE = _table(subject=_S, relation=_S, object=_S, method=_S, status=_S)
EVIDENCE = _table(entity_id=_S, field=_S, value=_S, status=_S, source=_S, n=_L)
INDEX = {"artifacts": ARTIFACTS, "captures": CAPTURES, "groups": GROUPS, "lineage": LINEAGE, "evidence": EVIDENCE}

SIGNAL_BLOCKS = _table(capture_id=_S, channel=_S, block_index=_L, start=_L, n=_I, i=_FLOATS, q=_FLOATS)
BLOCK_SAMPLES = 1 << 18

# Fixed values
RELATIONS = ["exact_copy_of", "derived_from", "contains_copy_of", "identical_content_to", "local_copy_of", "unmatched"]
INDEX_STATUSES = ["VERIFIED", "EMPIRICAL", "AUTHOR_DOC", "AUTHOR_CODE", "REPO_METADATA", "INFERRED", "CONFLICTING", "UNKNOWN",
                  "NOT_APPLICABLE", "ASSESSMENT"]
CLAIM_STATUSES = ["VERIFIED", "EMPIRICAL", "AUTHOR_DOC", "AUTHOR_CODE", "REPO_METADATA", "INFERRED", "CONFLICTING", "UNKNOWN",
                  "NOT_APPLICABLE", "UNGRADED"]
CLAIM_KINDS = ["FACT", "ASSESSMENT"]
N_UNITS = ["file", "archive", "archive_member", "capture", "clip", "recording", "pack", "class", "window", "physical_unit", "session"]

CONFLICT = T.ArrayType(_table(claim=_S, status=_S, source=_S, n=_L, n_unit=_S))
CLAIMS = _table(dataset_id=_S, modality=_S, section=_S, key=_S, label=_S, text=_S, kind=_S, status=_S, n=_L, n_unit=_S, source=_S,
                value=_S, varies=_B, conflict=CONFLICT)
POLICIES = _table(dataset_id=_S, key=_S, text=_S, basis=_S)
MATRIX_ROWS = _table(modality=_S, key=_S, label=_S, policy=_B, ord=_I)
MATRIX_COLUMNS = _table(modality=_S, dataset_id=_S, label=_S, ord=_I)
