"""Column functions on media paths and sidecar keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of images, those that are annotated as JPEG, and the suffixes of files made.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".heic", ".heif")
HEIC_EXTENSIONS = (".heic", ".heif")
SIDECAR, ANNOTATED = ".scar", "_scrfd"
KEY_PREFIX = "face."


def name_of(path: Column) -> Column:
    """Last part of a path."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_of(path: Column) -> Column:
    """Path without its last part; empty for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix_of(path: Column) -> Column:
    """Last suffix with its dot; empty without one, for names that only begin with a dot, and for a final dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def stem_of(path: Column) -> Column:
    """Name without its last suffix."""
    name = name_of(path)
    return F.substring(name, F.lit(1), F.char_length(name) - F.char_length(suffix_of(path)))


def bare(path: Column) -> Column:
    """Path without its last suffix."""
    return F.substring(path, F.lit(1), F.char_length(path) - F.char_length(suffix_of(path)))


def is_image(path: Column) -> Column:
    return F.lower(suffix_of(path)).isin(*IMAGE_EXTENSIONS)


def sidecar_path(path: Column) -> Column:
    """Path of an image's sidecar: last suffix swapped; sidecars in any case stay as they are."""
    return F.when(F.lower(suffix_of(path)) == SIDECAR, path).otherwise(F.concat(bare(path), F.lit(SIDECAR)))


def annotated_path(path: Column) -> Column:
    """Path of the annotated image; HEIC and HEIF become JPEG."""
    suffix = suffix_of(path)
    return F.concat(bare(path), F.lit(ANNOTATED), F.when(F.lower(suffix).isin(*HEIC_EXTENSIONS), ".jpg").otherwise(suffix))


def is_annotated(path: Column) -> Column:
    """Whether a path is an annotated image itself."""
    return stem_of(path).endswith(ANNOTATED)


def job_id(prefix: str, path: Column) -> Column:
    """Prefix and the first 24 hexadecimal digits of the path's sha256."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(path, 256), 1, 24))


def tool_key(tool: Column | str, field: Column | str) -> Column:
    """Entry key of a tool's field."""
    part = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat(F.lit(KEY_PREFIX), part(tool), F.lit("."), part(field))


def key_tool(key: Column) -> Column:
    """Tool of an entry key; null for keys of other namespaces or without a field."""
    return F.when(key.startswith(KEY_PREFIX) & (F.size(F.split(key, r"\.", 3)) == 3), F.split(key, r"\.", 3)[1])


def key_field(key: Column) -> Column:
    """Field of an entry key, null as key_tool()."""
    return F.when(key_tool(key).isNotNull(), F.split(key, r"\.", 3)[2])


def iso_utc(ts: Column) -> Column:
    """Whole seconds in UTC with the offset written +00:00 (the session's time zone must be UTC)."""
    return F.date_format(F.date_trunc("second", ts.cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ssxxx")


def year_of(path: Column) -> Column:
    """Year of the first 20XX folder; null without one."""
    year = F.regexp_extract(path, r"/(20[0-9]{2})/", 1)
    return F.when(year != "", year.cast("int"))
