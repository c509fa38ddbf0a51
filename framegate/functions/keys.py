"""Path, key, label and JSON column functions. Each takes and returns Columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Path parts, prefixes and labels of the data format.
FRAME_PATTERN = r"(?i)_f(\d+)(?:\.[^./]+)?$"
HASH_BITS_MAX = 281474976710655.0  # 0xFFFFFFFFFFFF
HASH_BITS_SPAN = 281474976710656.0  # 16 ** 12
SKIPPED_DOC_KEYS = ("mask", "crop_meta", "full_frame_mask")
FLAG_PREFIX = "selected_via_"


def after(text: Column, n: int) -> Column:
    """The text without its first ``n`` characters, however long it is."""
    return F.right(text, F.greatest(F.char_length(text) - n, F.lit(0)))


def normalize_path(path: Column, target: str = "posix") -> Column:
    """Drive letter form to mount form (``posix``) or back (``windows``); other paths unchanged."""
    if target == "posix":
        drive = F.regexp_extract(path, r"^([A-Za-z]):[\\/]", 1)
        rest = F.translate(after(path, 3), "\\", "/")
        return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.lit("/"), rest)).otherwise(path)
    drive = F.regexp_extract(path, r"^/mnt/([A-Za-z])/", 1)
    rest = after(path, 7)
    return F.when(drive != "", F.concat(F.upper(drive), F.lit(":/"), rest)).otherwise(path)


def canonical_path_key(path: Column) -> Column:
    return F.lower(F.translate(path, "/", "\\"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def strip_suffix(path: Column) -> Column:
    """Drop the last ``.ext`` of the last path part; a leading dot is not a suffix."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def output_stem(path: Column, root: str) -> Column:
    """Relative path without suffix, parts joined by two underscores; the bare stem outside the root."""
    prefix = root.rstrip("/") + "/"
    relative = after(path, len(prefix))
    return F.when(
        path.startswith(prefix), F.replace(strip_suffix(relative), F.lit("/"), F.lit("__"))
    ).otherwise(strip_suffix(file_name(path)))


def sanitize_stem(name: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(name, "[^0-9A-Za-z_-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("clip"))


def frame_group_key(path: Column, bucket_size: int = 25) -> Column:
    """``parent/video:bucketNNNNNNNN`` for numbered frames, ``parent/stem`` for everything else.

    Backslashes separate like slashes. Without a parent the key is ``./video:bucketNNNNNNNN`` or the stem alone.
    """
    path = F.translate(path, "\\", "/")
    nested = path.contains("/")
    digits = F.regexp_extract(path, FRAME_PATTERN, 1)
    bucket = F.floor(digits.try_cast("decimal(38,0)") / F.lit(max(1, bucket_size)).cast("bigint"))
    width = F.greatest(F.lit(8), F.length(bucket.cast("string")))
    numbered = F.concat(
        F.when(nested, parent_dir(path)).otherwise(F.lit(".")),
        F.lit("/"),
        F.regexp_replace(file_name(path), FRAME_PATTERN, ""),
        F.lit(":bucket"),
        F.lpad(bucket.cast("string"), width, F.lit("0")),
    )
    stem = strip_suffix(file_name(path))
    plain = F.when(nested, F.concat(parent_dir(path), F.lit("/"), stem)).otherwise(stem)
    return F.when(digits != "", numbered).otherwise(plain)


def candidate_source_group(source: Column) -> Column:
    """Group used by score bands and per-source tables: folds the numbered reticle sources only."""
    s = F.coalesce(source, F.lit(""))
    return F.when(s.startswith("reticle_global"), F.lit("reticle_global")).otherwise(s)


def model_source_group(source: Column) -> Column:
    """Group used by the learned scorers: also folds the external sources."""
    s = F.coalesce(source, F.lit(""))
    group = s
    for prefix in ("external_tiny", "external_main", "reticle_global"):
        group = F.when(s.startswith(prefix), F.lit(prefix)).otherwise(group)
    return group


def source_matches(source: Column, exact: str | None = None, group: str | None = None) -> Column:
    """Rule match: the exact name, the group name, or the group name followed by ``_``."""
    hit = F.lit(False)
    if exact is not None:
        hit = hit | (source == exact)
    if group is not None:
        hit = hit | (source == group) | source.startswith(f"{group}_")
    return F.coalesce(hit, F.lit(False))


def _number_text(value: float) -> str:
    return f"{value:g}"


def size_bucket_label(length: Column, bounds: Sequence[float]) -> Column:
    ordered = sorted(bounds)
    if not ordered:
        return F.lit("all")
    label = F.lit(f">={_number_text(ordered[-1])}")
    for bound in reversed(ordered):
        label = F.when(length < bound, F.lit(f"<{_number_text(bound)}")).otherwise(label)
    return label


def size_bucket_index(length: Column, bounds: Sequence[float]) -> Column:
    index = F.lit(len(bounds))
    for i, bound in reversed(list(enumerate(sorted(bounds)))):
        index = F.when(length < bound, F.lit(i)).otherwise(index)
    return index


def stable_hex(key: Column) -> Column:
    return F.substring(F.sha1(key.cast("binary")), 1, 12)


def stable_fraction(key: Column, span: float = HASH_BITS_MAX) -> Column:
    """First twelve hex digits of SHA-1 as a fraction; pass ``HASH_BITS_SPAN`` for the half-open form."""
    return F.conv(stable_hex(key), 16, 10).cast("double") / F.lit(span)


def base_sample_id(sample_id: Column) -> Column:
    return F.substring_index(sample_id, "_crop", 1)


def tiny_line_flag(
    area: Column, width: Column, height: Column, box_w: Column, box_h: Column,
    max_area_ratio: float = 0.002, max_bbox_side: int = 90,
) -> Column:
    pixels = F.greatest(F.lit(1), width * height)
    small = (area / pixels <= max_area_ratio) | (F.greatest(box_w, box_h, F.lit(1)) <= max_bbox_side)
    return (area > 0) & small


def slim_document(doc: Column, max_entries: int = 512) -> Column:
    """JSON text without nulls, nested lists and lists over ``max_entries``, at every level.

    Built-ins can take a document apart, but not put one of open depth together, so a small Arrow-batched helper does it.
    """

    def slim(value):
        if isinstance(value, dict):
            kept = {k: slim(v) for k, v in value.items()}
            return {k: v for k, v in kept.items() if v is not None}
        if isinstance(value, list):
            flat = len(value) <= max_entries and not any(isinstance(v, (dict, list)) for v in value)
            return value if flat else None
        return value

    @F.pandas_udf(T.StringType())
    def apply(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: json.dumps(slim(json.loads(d)), separators=(",", ":")) if d else None)

    return apply(doc)


def winner_flags(flags: Column, only_true: bool = True) -> Column:
    """From a ``map<string,boolean>`` keep the ``selected_via_*`` keys, prefix removed."""
    kept = F.map_filter(flags, lambda k, v: k.startswith(FLAG_PREFIX) & (v | F.lit(not only_true)))
    return F.transform_keys(kept, lambda k, v: after(k, len(FLAG_PREFIX)))


def winner_pred_pixels(own: Column, values: Column) -> Column:
    """The document's own pixel count, else the largest ``*_pred_area`` / ``*_pred_pixels`` value."""
    areas = F.map_filter(
        values,
        lambda k, v: ~k.startswith("pre_")
        & (k.endswith("_pred_area") | k.endswith("_pred_pixels"))
        & v.isNotNull(),
    )
    whole = F.transform(F.map_values(areas), lambda v: v.cast("bigint"))
    return F.coalesce(own.cast("bigint"), F.array_max(whole), F.lit(0).cast("bigint"))


def is_positive_item(split: Column, kind: Column, mask_path: Column) -> Column:
    return (
        (F.coalesce(mask_path, F.lit("")) != "")
        | F.lower(F.coalesce(kind, F.lit(""))).startswith("positive")
        | split.contains("positive")
    )


def row_metric(value: Column, fallback: Column | None = None, default: float = 0.0) -> Column:
    picked = value if fallback is None else F.coalesce(value, fallback)
    return F.coalesce(picked.try_cast("double"), F.lit(default))


def dataset_class(raw: Column) -> Column:
    label = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(label.isin("main", "quarantine"), label).otherwise(F.lit("legacy"))


def triplet_paths(image: Column) -> dict[str, Column]:
    """Sibling mask and preview paths of ``…/images/name`` and the group its parts name."""
    root = parent_dir(parent_dir(image))
    in_images = F.lower(file_name(parent_dir(image))) == "images"

    def sibling(folder: str) -> Column:
        return F.when(in_images, F.concat(root, F.lit(f"/{folder}/"), file_name(image)))

    parts = F.split(F.lower(image), "/")
    return {
        "mask_path": sibling("masks"),
        "preview_path": sibling("previews"),
        "group": F.when(F.array_contains(parts, "quarantine"), "quarantine").otherwise("main"),
    }


def frame_name(base: Column, index: Column, ext: str = ".png") -> Column:
    return F.format_string(f"%s_%06d{ext}", base, index)


def crop_id(index: Column) -> Column:
    return F.format_string("crop_%02d", index)
