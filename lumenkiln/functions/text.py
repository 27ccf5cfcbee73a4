"""Text, names, hashes and identifiers as column expressions."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by kind.
PHOTO_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "heic", "heif", "gif", "bmp", "tif", "tiff", "dng", "nef", "cr2", "cr3", "arw", "raf", "orf", "rw2"]
VIDEO_EXTENSIONS = ["mp4", "mov", "m4v", "avi", "mkv", "webm", "3gp", "mts"]
RAW_EXTENSIONS = ["dng", "nef", "cr2", "cr3", "arw", "raf", "orf", "rw2"]
MIME_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "heic": "image/heic", "gif": "image/gif", "mp4": "video/mp4", "mov": "video/quicktime"}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def media_type(name: Column) -> Column:
    e = extension(name)
    return F.when(e.isin(*PHOTO_EXTENSIONS), "Photo").when(e.isin(*VIDEO_EXTENSIONS), "Video")


def mime_type(name: Column, default: str = "application/octet-stream") -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit(default))


def previewable(name: Column) -> Column:
    """Photos that are not raw files."""
    return extension(name).isin(*[e for e in PHOTO_EXTENSIONS if e not in RAW_EXTENSIONS])


def normal_mime(value: Column) -> Column:
    return F.lower(F.trim(F.split(value, ";")[0]))


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def safe_text(value: Column, most: int = 500) -> Column:
    return F.nullif(F.left(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(most)), F.lit(""))


def like_pattern(text: str) -> str:
    """The user's wildcards stay wildcards."""
    return f"%{text.lower()}%"


def matches(value: Column, text: str) -> Column:
    return F.lower(value).like(like_pattern(text))


def contains(value: Column, text: str) -> Column:
    return F.coalesce(F.instr(F.lower(value), text.lower()) > 0, F.lit(False))


def clip_caption(value: Column, words: int) -> Column:
    """First sentence of the text with single blanks, at most so many words, with a full stop."""
    clean = F.trim(F.regexp_replace(value, r"\s+", " "))
    first = F.split(clean, r"(?<=[.!?]) ")[0]
    cut = F.concat_ws(" ", F.slice(F.split(first, " "), 1, words))
    return F.when(cut == "", "").when(cut.rlike(r"[.!?]$"), cut).otherwise(F.concat(cut, F.lit(".")))


def normal_description(value: Column, words: int) -> Column:
    """One sentence of at most so many words; null if blank or more than one sentence."""
    clean = F.trim(F.regexp_replace(value, r"\s+", " "))
    many = F.size(F.split(clean, " ")) > words
    cut = F.when(many, F.regexp_replace(F.concat_ws(" ", F.slice(F.split(clean, " "), 1, words)), r"[.!?]+$", "")).otherwise(clean)
    done = F.when(cut.rlike(r"[.!?]$"), cut).otherwise(F.concat(cut, F.lit(".")))
    return F.when((clean != "") & ~clean.rlike(r"""[.!?]["')\]]*\s+\S"""), done)


def item_id(relative_path: Column) -> Column:
    return F.concat(F.lit("path:"), F.sha2(relative_path, 256))


def item_revision(size: Column, mtime_ns: Column, content_sha: Column | None = None) -> Column:
    """Revision of a file; ``pending`` stands for a hash that is still to come."""
    return F.sha2(F.concat_ws(":", size.cast("string"), mtime_ns.cast("string"), content_sha if content_sha is not None else F.lit("pending")), 256)


def legacy_id(path: Column) -> Column:
    return F.sha1(F.lower(path))


def coordinate_revision(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.sha2(F.concat_ws(",", lat.cast("decimal(9,6)").cast("string"), lon.cast("decimal(10,6)").cast("string")), 256))


def public_id(kind: str, *keys: Column) -> Column:
    """A stable id instead of a random one, so that a rerun gives the same rows."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *[k.cast("string") for k in keys]), 256)


def encode_cursor(kind: str, position: list) -> str:
    raw = json.dumps({"v": 1, "k": kind, "p": position}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str | None, kind: str) -> list | None:
    """Position of a cursor; ValueError for one that is malformed or of another kind."""
    if cursor is None:
        return None
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except Exception as e:
        raise ValueError("malformed cursor") from e
    if not isinstance(found, dict) or found.get("v") != 1 or found.get("k") != kind or not isinstance(found.get("p"), list):
        raise ValueError("cursor of another kind or version")
    return found["p"]


def cursor_column(kind: str, *position: Column) -> Column:
    """The same encoding as a column, for positions of strings and whole numbers."""
    body = F.to_json(F.struct(F.lit(1).alias("v"), F.lit(kind).alias("k"), F.array(*[p.cast("string") for p in position]).alias("p")))
    return F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/", "-_"), F.lit("="))
