"""Pictures in planes: cutting planes out of padded buffers, NV12 to I420, packing and unpacking; native expressions over binaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import writers as W


def half(n: Column) -> Column:
    """Samples of a subsampled side, rounded up."""
    return F.ceil(n / 2).cast("int")


def plane(data: Column, offset: Column, stride: Column, width: Column, height: Column) -> Column:
    """Rows of ``width`` bytes that lie ``stride`` apart, side by side."""
    rows = F.when(height > 0, F.sequence(F.lit(0), (height - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return W.joined(F.transform(rows, lambda r: F.substring(data, (offset + r * stride + 1).cast("int"), width.cast("int"))))


def every_other(data: Column, first: int) -> Column:
    """Bytes 0, 2, 4, ... or 1, 3, 5, ... of a binary."""
    return F.unhex(F.regexp_replace(F.hex(data), "(..)(..)", f"${first + 1}"))


def nv12_to_i420(data: Column, luma: tuple[Column, Column], chroma: tuple[Column, Column], width: Column, height: Column) -> Column:
    """struct<y, u, v> of a picture whose blue and red samples lie in turn; (offset, stride) of both planes."""
    pairs = plane(data, *chroma, 2 * half(width), half(height))
    return F.struct(plane(data, *luma, width, height).alias("y"), every_other(pairs, 0).alias("u"), every_other(pairs, 1).alias("v"))


def i420_planes(data: Column, width: Column, height: Column) -> Column:
    """struct<y, u, v> of a tightly packed picture; null where the size is not that of the picture."""
    y, c = (width * height).cast("int"), half(width) * half(height)
    parts = F.struct(F.substring(data, F.lit(1), y).alias("y"), F.substring(data, y + 1, c).alias("u"), F.substring(data, y + c + 1, c).alias("v"))
    return F.when(F.length(data) == y + 2 * c, parts)


def packed(planes: Column) -> Column:
    """The planes of a picture side by side; missing ones are empty."""
    empty = F.lit(b"")
    return F.concat(*[F.coalesce(planes[k], empty) for k in ("y", "u", "v")])


def yuv_file(frame_id: Column, planes: Column, width: Column, height: Column, pts_us: Column) -> Column:
    """struct<file_name, mime_type, extension, data, metadata>: a picture as a raw file."""
    facts = F.to_json(F.struct(F.lit("I420").alias("format"), width.alias("width"), height.alias("height"), pts_us.alias("pts_us")))
    return F.struct(F.concat(frame_id.cast("string"), F.lit(".yuv")).alias("file_name"), F.lit("application/octet-stream").alias("mime_type"), F.lit("yuv").alias("extension"), packed(planes).alias("data"), facts.alias("metadata"))


def export_note(file: Column) -> Column:
    """What an export tells of a file: its names, kind and size as JSON."""
    return F.to_json(F.struct(file["file_name"].alias("fileName"), file["mime_type"].alias("mimeType"), file["extension"].alias("extension"), F.length(file["data"]).alias("byteLength"), file["metadata"].alias("metadata")))
