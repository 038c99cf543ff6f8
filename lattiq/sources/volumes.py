"""Readers: multipage TIFF volumes, region-of-interest records, RGB rasters, keyframes, packets, axis texts, settings."""

from __future__ import annotations

import mmap
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattiq.functions.shaping import axis_value

#: Fixed values of the TIFF format: tags, and the bytes of each field type.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PREDICTOR, _FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 339
_NONE, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


def tiff_pages(data: bytes) -> list[dict[int, tuple]]:
    """The tags of each page of a classic or big TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    magic = struct.unpack(order + "H", data[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    big = magic == 43
    at = struct.unpack(order + "Q", data[8:16])[0] if big else struct.unpack(order + "I", data[4:8])[0]
    pages = []
    while at:
        n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        tags = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at)
            count = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)[0]
            where = at + (12 if big else 8)
            if count * _SIZES.get(kind, 1) > (8 if big else 4):
                where = struct.unpack_from(order + ("Q" if big else "I"), data, where)[0]
            if kind in _CODES:
                tags[tag] = struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, where)
            at += 20 if big else 12
        at = struct.unpack_from(order + ("Q" if big else "I"), data, at)[0]
        pages.append(tags | {0: (order,)})
    return pages


def unpackbits(data: bytes) -> bytes:
    """PackBits: a signed count, then that many bytes and one more as they are, or one byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    """LZW as TIFF writes it: codes of 9 to 12 bits, the highest bit first, each width one code short; 256 clears, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, bits, before, out = list(first), 9, 0, 0, b"", bytearray()
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, before = list(first), 9, b""
                continue
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before:
                table.append(before + entry[:1])
            before = entry
            width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


_UNPACK = {_NONE: bytes, _LZW: unlzw, _DEFLATE: zlib.decompress, _OLD_DEFLATE: zlib.decompress, _PACKBITS: unpackbits}


def tiff_page(data, tags: dict[int, tuple]) -> np.ndarray:
    """The samples of a page (height, width) or (height, width, samples); data: the file, of which only the page's strips are read."""
    unpack = _UNPACK.get(tags.get(_COMPRESSION, (_NONE,))[0])
    if unpack is None or _OFFSETS not in tags:
        raise ValueError("a compression or a layout of TIFF pages that is not supported")
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(_FORMAT, (1,))[0]]
    dtype = np.dtype(f"{tags[0][0]}{kind}{tags.get(_BITS, (8,))[0] // 8}")
    raw = b"".join(unpack(bytes(data[a : a + n])) for a, n in zip(tags[_OFFSETS], tags[_COUNTS], strict=True))
    samples = tags.get(_SAMPLES, (1,))[0]
    shape = (tags[_HEIGHT][0], tags[_WIDTH][0], samples)
    page = np.frombuffer(raw, dtype, int(np.prod(shape))).reshape(shape)
    if tags.get(_PREDICTOR, (1,))[0] == 2:
        page = np.cumsum(page, axis=1, dtype=dtype)
    return page if samples > 1 else page[:, :, 0]


def write_tiff(volume: np.ndarray, deflate: bool = False) -> bytes:
    """A multipage TIFF of a 3-D array, one page (and one strip) a plane; a last axis of 3 beside three others makes RGB pages."""
    kind = {"u": 1, "i": 2, "f": 3}[volume.dtype.kind]
    out, at = bytearray(b"II*\0\0\0\0\0"), 4
    for plane in np.ascontiguousarray(volume.astype(volume.dtype.newbyteorder("<"))):
        start, raw = len(out), plane.tobytes()
        raw = zlib.compress(raw) if deflate else raw
        out += raw + b"\0" * (len(raw) % 2)
        samples = plane.shape[2] if plane.ndim == 3 else 1
        struct.pack_into("<I", out, at, len(out))
        tags = [(_WIDTH, 4, plane.shape[1]), (_HEIGHT, 4, plane.shape[0]), (_BITS, 3, 8 * volume.dtype.itemsize), (_COMPRESSION, 3, _DEFLATE if deflate else _NONE), (262, 3, 2 if samples > 1 else 1), (_OFFSETS, 4, start), (_SAMPLES, 3, samples), (_ROWS, 4, plane.shape[0]), (_COUNTS, 4, len(raw)), (_FORMAT, 3, kind)]
        out += struct.pack("<H", len(tags))
        for tag, t, v in sorted(tags):
            out += struct.pack("<HHII" if t == 4 else "<HHIHxx", tag, t, 1, v)
        at = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def decoded(files: DataFrame, above: float | None = None) -> DataFrame:
    """path, z, y, x, v of the voxels of TIFF volumes (path, content); only those above a value, if given, leave the decoder.

    Axes of length one are squeezed; what is not a volume of equal planes then is an error."""

    def planes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                shapes = set()
                for z, tags in enumerate(tiff_pages(data)):
                    plane = tiff_page(data, tags).squeeze()
                    shapes.add(plane.shape)
                    if plane.ndim != 2 or len(shapes) > 1:
                        raise ValueError(f"{name} is not a 3-D volume")
                    y, x = np.nonzero(plane > above) if above is not None else np.indices(plane.shape).reshape(2, -1)
                    yield pd.DataFrame({"path": name, "z": z, "y": y, "x": x, "v": plane[y, x].astype(float)})

    return files.select("path", "content").mapInPandas(planes, "path string, z bigint, y bigint, x bigint, v double")


def read_tiff(spark: SparkSession, path: str, above: float | None = None) -> DataFrame:
    """path, z, y, x, v of the voxels of TIFF volumes, see decoded().

    Files come through Spark's binary reader, so any store it knows works, up to 2 GB a file; larger ones go through
    format("voxel_tiff")."""
    return decoded(spark.read.format("binaryFile").load(path), above)


def labels_of(volume: DataFrame) -> DataFrame:
    """A label volume: v as a small integer (0 to 255); others are an error."""
    label = F.when(F.col("v").between(0, 255) & (F.col("v") == F.floor("v")), F.col("v").cast("smallint"))
    return volume.withColumn("label", F.coalesce(label, F.raise_error(F.lit("not a label volume")).cast("smallint"))).drop("v")


#: Rows of small files that a decoder sends at once: a table of its own for each costs more than reading it.
SENT = 50_000


def panels(files: DataFrame, height: int, width: int) -> DataFrame:
    """path, y, x, r, g, b of RGB rasters (path, content); another shape is an error."""

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.indices((height, width)).reshape(2, -1)
        many = max(1, SENT // (height * width))
        for whole in batches:
            for at in range(0, len(whole), many):
                pdf, pages = whole.iloc[at : at + many], []
                for name, data in zip(pdf["path"], pdf["content"], strict=True):
                    page = tiff_page(data, tiff_pages(data)[0])
                    if page.shape != (height, width, 3):
                        raise ValueError(f"{name} has the shape {page.shape}")
                    pages.append(page.reshape(-1, 3).astype(int))
                rgb = np.concatenate(pages)
                yield pd.DataFrame({"path": np.repeat(pdf["path"].to_numpy(), len(y)), "y": np.tile(y, len(pdf)), "x": np.tile(x, len(pdf)), **{c: rgb[:, k] for k, c in enumerate("rgb")}})

    return files.select("path", "content").mapInPandas(pixels, "path string, y bigint, x bigint, r bigint, g bigint, b bigint")


def read_roi(spark: SparkSession, path: str) -> DataFrame:
    """The points of polygon records in files, see roi_rows()."""
    return roi_rows(spark.read.format("binaryFile").load(path))


def roi_rows(files: DataFrame) -> DataFrame:
    """path, kind, top, left, bottom, right, i, x, y of polygon records (path, content): big-endian, a header of 64 bytes, then
    all x and all y relative to the box, as float32 where option 128 is set, else as int16."""

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows = ["path", "kind", "top", "left", "bottom", "right", "i", "x", "y"], []
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows += [(name, *r.values()) for r in roi_points(data)]  # in the order of names
                if len(rows) >= SENT:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(points, "path string, kind int, top int, left int, bottom int, right int, i int, x double, y double")


#: Fixed places in the header of a region record: kind, box, number of points, options, and where the second header stands.
_KIND, _BOX, _N, _OPTIONS, _SECOND, _HEAD = 6, 8, 16, 50, 60, 64


def roi_points(data: bytes) -> list[dict]:
    if data[:4] != b"Iout":
        raise ValueError("not a region record")
    top, left, bottom, right, n = struct.unpack_from(">4hH", data, _BOX)
    if not n:
        raise ValueError("a region without points")
    kind = ">f4" if struct.unpack_from(">H", data, _OPTIONS)[0] & 128 else ">i2"
    xy = np.frombuffer(data, kind, 2 * n, _HEAD).astype(float).reshape(2, n) + [[left], [top]]
    return [{"kind": data[_KIND], "top": top, "left": left, "bottom": bottom, "right": right, "i": i, "x": float(x), "y": float(y)} for i, (x, y) in enumerate(xy.T)]


def write_roi(points: list[tuple[float, float]], kind: int = 0, like: bytes | None = None, exact: bool = True) -> bytes:
    """A record of points (x, y) with its box and their number anew; coordinates as float32, or rounded to int16.

    like: a record whose header, options (which say how coordinates are kept) and second header stay."""
    xy = np.array(points, float).T
    left, top = np.floor(xy.min(1)).astype(int)
    right, bottom = np.ceil(xy.max(1)).astype(int)
    head = bytearray(like[:_HEAD] if like else _HEAD)
    if not like:
        head[:4] = b"Iout"
        struct.pack_into(">hB", head, 4, 227, kind)
        struct.pack_into(">H", head, _OPTIONS, 128 if exact else 0)
    exact = bool(struct.unpack_from(">H", head, _OPTIONS)[0] & 128)
    struct.pack_into(">4hH", head, _BOX, top, left, bottom, right, xy.shape[1])
    near = xy - [[left], [top]]
    body = near.astype(">f4").tobytes() if exact else np.round(near).astype(">i2").tobytes()
    second = struct.unpack_from(">i", head, _SECOND)[0]
    if second > 0:
        struct.pack_into(">i", head, _SECOND, _HEAD + len(body))
    return bytes(head) + body + (like[second:] if second > 0 else b"")


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """ts, dur, size of packet lines pts,dts,duration,size,flags: N/A is missing, dts stands in for pts, negative times
    become 0, and rows without time or size are left out."""
    rows = spark.read.schema("pts string, dts string, duration string, size string, flags string").option("mode", "PERMISSIVE").csv(path)
    num = lambda c: F.expr(f"try_cast({c} as double)")
    out = rows.select(F.greatest(F.coalesce(num("pts"), num("dts")), F.lit(0.0)).alias("ts"), F.coalesce(num("duration"), F.lit(0.0)).alias("dur"), F.expr("try_cast(size as bigint)").alias("size"), F.coalesce(num("pts"), num("dts")).isNotNull().alias("timed"))
    return out.filter("timed and size is not null").drop("timed")


def read_axis(spark: SparkSession, path: str) -> DataFrame:
    """path, cx, cy of texts with lines X=..., Y=... (either case; the last one counts)."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", axis_value(F.col("value"), "X").alias("cx"), axis_value(F.col("value"), "Y").alias("cy"))


KEYFRAME = "index int, timestamp string, camera struct<position:array<double>,focal_point:array<double>,view_up:array<double>,view_angle:double>, actor struct<position:array<double>,orientation:array<double>,scale:array<double>,origin:array<double>>, ui_state map<string,string>"


def read_keyframes(spark: SparkSession, path: str) -> DataFrame:
    """Keyframes of a JSON list (a single object counts as a list of one); a missing actor gets the neutral one."""
    rows = spark.read.schema(KEYFRAME).option("multiLine", True).json(path)
    zero, one = F.array(*(F.lit(0.0),) * 3), F.array(*(F.lit(1.0),) * 3)
    actor = F.struct(*(F.coalesce(F.col(f"actor.{c}"), d).alias(c) for c, d in (("position", zero), ("orientation", zero), ("scale", one), ("origin", zero))))
    return rows.withColumn("legacy", F.col("actor").isNull()).withColumn("actor", actor)


def latest(spark: SparkSession, path: str) -> str | None:
    """The last file by name."""
    return spark.read.format("binaryFile").load(path).agg(F.max("path")).first()[0]


def merged_settings(defaults: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of defaults with what `given` says instead, column by column; labels that only one side has stay."""
    values = [c for c in defaults.columns if c not in keys]
    g = given.select(*keys, *(F.col(c).alias(f"_{c}") if c in given.columns else F.lit(None).alias(f"_{c}") for c in values))
    return defaults.join(g, keys, "full").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in values))


class _Plane(InputPartition):
    def __init__(self, path: str, z: int, tags: dict[int, tuple]):
        self.path, self.z, self.tags = path, z, tags


class _Reader(DataSourceReader):
    """Reads the directory once, and of a plane its strips alone; files are mapped, not loaded."""

    def __init__(self, path: str, above: float | None):
        self.path, self.above = path, above

    def partitions(self):
        with open(self.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return [_Plane(self.path, z, tags) for z, tags in enumerate(tiff_pages(data))]

    def read(self, part: _Plane):
        with open(part.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            plane = tiff_page(data, part.tags)
        y, x = np.nonzero(plane > self.above) if self.above is not None else np.indices(plane.shape).reshape(2, -1)
        yield from zip([part.z] * len(y), y.tolist(), x.tolist(), plane[y, x].astype(float).tolist(), strict=True)


class VoxelTiff(DataSource):
    """format("voxel_tiff"): one partition a plane, for volumes on a file system that all workers mount."""

    @classmethod
    def name(cls) -> str:
        return "voxel_tiff"

    def schema(self) -> str:
        return "z bigint, y bigint, x bigint, v double"

    def reader(self, schema):
        above = self.options.get("above")
        return _Reader(self.options["path"], float(above) if above is not None else None)
