"""Media files: listing, hashing, metadata, previews, rules and migration scripts."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import Rule
from ..functions.text import PHOTO_EXTENSIONS, VIDEO_EXTENSIONS, media_type


def list_files(spark: SparkSession, root: str, *, pattern: str | None = None) -> DataFrame:
    """path, size and modification time of all files below root; contents are not read.  The reader passes over empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select("path", F.col("length").alias("byte_size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"))


def supported(files: DataFrame) -> DataFrame:
    """Files of a known kind, with it."""
    return files.withColumn("media_type", media_type(F.col("path"))).filter("media_type is not null")


def stat_pass(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with content, skipped ones): an empty file is skipped, not failed."""
    return files.filter("byte_size > 0"), files.filter("byte_size = 0")


def hashed(spark: SparkSession, root: str) -> DataFrame:
    """Content SHA-256 of every file, in the JVM."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return read.select("path", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("content_sha256"))


def cached(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with what the cache holds, misses): a hit has the same path, size and modification time."""
    keys = ["path", "byte_size", "modified_at"]
    return files.join(cache, keys), files.join(cache, keys, "left_anti")


METADATA = "path string, width long, height long, exif_time string, exif_offset string, latitude double, longitude double, altitude double, error string"


def _png_or_jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Pixel size from the headers, without decoding."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + size
    return None


#: Bytes of one value of a TIFF field, by its type.
_WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}


def _tiff_block(data: bytes) -> bytes | None:
    """The TIFF structure that holds the EXIF fields: an APP1 segment, an eXIf chunk, or the file itself."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            if kind == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    return None


def _fields(tiff: bytes, at: int) -> dict[int, list | str]:
    """Fields of one directory: texts, or lists of numbers (rationals as floats, None where the denominator is 0)."""
    order = "little" if tiff[:2] == b"II" else "big"
    number = lambda a, n, signed=False: int.from_bytes(tiff[a : a + n], order, signed=signed)
    out: dict[int, list | str] = {}
    for i in range(number(at, 2)):
        entry = at + 2 + 12 * i
        if entry + 12 > len(tiff):
            break
        tag, kind, count = number(entry, 2), number(entry + 2, 2), number(entry + 4, 4)
        width = _WIDTHS.get(kind, 0) * count
        place = entry + 8 if width <= 4 else number(entry + 8, 4)
        if not width or place + width > len(tiff):
            continue
        if kind == 2:
            out[tag] = tiff[place : place + count].split(b"\0")[0].decode("ascii", "replace").strip()
        elif kind in (5, 10):
            pairs = [(number(place + 8 * j, 4, kind == 10), number(place + 8 * j + 4, 4, kind == 10)) for j in range(count)]
            out[tag] = [a / b if b else None for a, b in pairs]
        else:
            out[tag] = [number(place + j * _WIDTHS[kind], _WIDTHS[kind], kind in (6, 8, 9)) for j in range(count)]
    return out


def exif(data: bytes) -> dict:
    """Capture time, offset and place from the EXIF fields; the original time counts before the digitised one and that before the file's."""
    tiff = _tiff_block(data)
    if tiff is None:
        return {}
    order = "little" if tiff[:2] == b"II" else "big"
    main = _fields(tiff, int.from_bytes(tiff[4:8], order))
    sub, gps = (_fields(tiff, main[tag][0]) if tag in main else {} for tag in (0x8769, 0x8825))
    when, offset = next(((t, o) for t, o in ((sub.get(0x9003), sub.get(0x9011)), (sub.get(0x9004), sub.get(0x9012)), (main.get(0x0132), sub.get(0x9010))) if t), (None, None))
    out = {"exif_time": when, "exif_offset": offset or None}

    def degrees(value, ref):
        if not isinstance(value, list) or len(value) != 3 or None in value:
            return None
        return (-1 if ref in ("S", "W") else 1) * (value[0] + value[1] / 60 + value[2] / 3600)

    lat, lon = degrees(gps.get(2), gps.get(1)), degrees(gps.get(4), gps.get(3))
    if lat is not None and lon is not None:
        height = (gps.get(6) or [None])[0]
        out |= {"latitude": lat, "longitude": lon, "altitude": None if height is None else -height if (gps.get(5) or [0])[0] == 1 else height}
    return out


def photo_metadata(files: DataFrame) -> DataFrame:
    """Size, capture time and place of photos (path, content); a file that can't be read gives an error, not a failure."""

    def run(frames: Iterator):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                row = dict.fromkeys(c.split()[0] for c in METADATA.split(", ")) | {"path": path}
                try:
                    size = _png_or_jpeg_size(bytes(content))
                    row |= {"width": size[0], "height": size[1]} if size else {}
                    row |= exif(bytes(content))
                except Exception as e:  # any decoder error belongs to the file
                    row["error"] = type(e).__name__
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in METADATA.split(", ")]).astype({"width": "Int64", "height": "Int64"})

    return files.select("path", "content").mapInPandas(run, METADATA)


PROBE = "streams array<struct<codec_type:string,width:long,height:long>>, format struct<duration:string,tags:map<string,string>>"


def video_metadata(probes: DataFrame) -> DataFrame:
    """Size, duration, creation time and place from stored probe JSON (path, probe); the probe itself is pluggable."""
    from ..functions.geo import iso6709

    p = F.from_json("probe", PROBE)
    stream = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    tags = p["format"]["tags"]
    lat, lon = iso6709(F.coalesce(F.try_element_at(tags, F.lit("com.apple.quicktime.location.ISO6709")), F.try_element_at(tags, F.lit("location"))))
    return probes.select(
        "path", stream["width"].alias("width"), stream["height"].alias("height"), F.round(p["format"]["duration"].try_cast("double") * 1000).cast("long").alias("duration_ms"),
        F.try_element_at(tags, F.lit("creation_time")).try_cast("timestamp").cast("timestamp_ntz").alias("captured_utc"), lat.alias("latitude"), lon.alias("longitude"),
    )


def previews(files: DataFrame, *, side: int = 1024, quality: int = 85) -> DataFrame:
    """JPEG previews (path, preview): oriented, on white, at most ``side`` pixels; null where Pillow is missing or fails."""

    def run(frames: Iterator):
        import io

        import pandas as pd

        try:
            from PIL import Image, ImageOps
        except ImportError:
            Image = None
        for frame in frames:
            out = []
            for content in frame["content"]:
                made = None
                if Image is not None:
                    try:
                        with Image.open(io.BytesIO(bytes(content))) as image:
                            image = ImageOps.exif_transpose(image).convert("RGBA")
                            flat = Image.new("RGB", image.size, "white")
                            flat.paste(image, mask=image.split()[3])
                            flat.thumbnail((side, side))
                            held = io.BytesIO()
                            flat.save(held, "JPEG", quality=quality)
                            made = held.getvalue()
                    except Exception:  # a broken file has no preview
                        made = None
                out.append(made)
            yield pd.DataFrame({"path": frame["path"], "preview": out})

    return files.select("path", "content").mapInPandas(run, "path string, preview binary")


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Normalisation rules in their order, from an object with Rules or a bare array."""
    import json

    found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    rules = found.get("Rules", []) if isinstance(found, dict) else found
    return [
        Rule(r.get("Name", ""), r.get("NormalizedStreetAddress", ""), r.get("CityEquals"), r.get("StateIn") or [], r.get("CountryIn") or [], r.get("StreetContainsAny") or [], r.get("OriginalStreetNumberIn") or [])
        for r in rules
    ]


def split_statements(script: str) -> list[str]:
    """Statements of a script; semicolons inside quotes don't part them."""
    parts = re.findall(r"""(?:'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|[^;])+""", script)
    return [p.strip() for p in parts if p.strip()]


def pending_migrations(spark: SparkSession, names: list[str], applied: DataFrame) -> DataFrame:
    """Files that were not applied yet, in name order."""
    return spark.createDataFrame([(n,) for n in names], "version string").join(applied, "version", "left_anti").orderBy("version")


SUPPORTED = {"Photo": PHOTO_EXTENSIONS, "Video": VIDEO_EXTENSIONS}
