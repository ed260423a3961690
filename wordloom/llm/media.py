"""Media columns: Netpbm and BMP images as numpy arrays, resized by area and kept as NPY tiles with difference hashes.

Images are resized by integral images: the sum over any rectangle, also with fractional sides, is a difference of
integral values, which are linear between pixel borders. Only the integral's rows next to output borders are formed,
so memory stays a small multiple of the image.

Tiles are written to the shared folder as a table of NPY files; difference hashes are taken from the tiles that are
read back.

Edge cases: null media give null results; images that cannot be decoded give an ``error`` and null results; an empty
text is one row of 64 zero samples; equal rows get equal results; very long texts are tall images, resized in strips;
tables without rows give none; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import col, map_cells, map_texts, materialise, table

WIDTH = 64
TILE = (16, 16)
#: Bit fields of red, green and blue that are those of a BMP without any.
MASKS = (0xFF0000, 0xFF00, 0xFF)
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


class BadImage(ValueError):
    """Bytes that are no image of a known kind."""


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit grey image as binary Netpbm (P5)."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit grey image as BMP with a grey palette, bottom row first."""
    height, width = samples.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + palette.tobytes() + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3)."""
    kind, at, head = data[:2], 2, []
    while len(head) < (2 if kind in (b"P1", b"P4") else 3):
        if not (m := _TOKEN.match(data, at)):
            raise BadImage("short Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, most = head[0], head[1], (head[2:] or [1])[0]
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * channels
    if width < 1 or height < 1 or not 0 < most < 65536:
        raise BadImage("bad Netpbm header")
    need = {b"P4": -(-width // 8) * height, b"P5": n, b"P6": n}.get(kind, 0) * (1 if most < 256 else 2)
    if len(data) < at + 1 + need:
        raise BadImage("short Netpbm data")
    if kind in (b"P1", b"P2", b"P3"):
        plain = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array([c - 48 for c in plain if c in b"01"] if kind == b"P1" else plain.split(), dtype=np.int64)[:n]
    elif kind == b"P4":
        stride = -(-width // 8)
        values = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if values.size < n:
        raise BadImage("short Netpbm data")
    if kind in (b"P1", b"P4"):
        values = 1 - values.astype(np.uint8)  # in bitmaps 1 is black
    values = values.astype(np.uint8 if most < 256 else np.uint16, copy=False)
    return values.reshape(height, width) if channels == 1 else values.reshape(height, width, 3)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits; palettes that are grey give one channel."""
    if len(data) < 54:
        raise BadImage("short BMP")
    start, header, width, height, _, bits, packing = struct.unpack_from("<10xIIiiHHI", data)
    if packing not in (0, 3) or bits not in (8, 24, 32) or width < 1 or height == 0:
        raise BadImage("BMP of an unknown kind")
    if packing == 3 and (bits != 32 or struct.unpack_from("<3I", data.ljust(66, b"\0"), 54) != MASKS):
        raise BadImage("BMP with bit fields of its own")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    if len(data) < start + rows * stride:
        raise BadImage("short BMP data")
    grid = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)[:, : width * bits // 8]
    grid = grid[::-1] if height > 0 else grid
    if bits > 8:
        return grid.reshape(rows, width, bits // 8)[:, :, 2::-1]
    colours = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.zeros((256, 3), np.uint8)
    palette[:colours] = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(colours, 4)[:, 2::-1]
    picked = palette[grid]
    return picked[:, :, 0] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else picked


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return decode_netpbm(data)
    raise BadImage("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, by the integral image at the borders of the output cells."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    h, w = grey.shape
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    near = np.unique(np.concatenate([[0, h], np.floor(ys), np.ceil(ys)]).astype(np.int64))
    strips = np.add.reduceat(grey, near[:-1], axis=0, dtype=np.float64)  # column sums between the integral's rows needed
    integral = np.zeros((len(near), w + 1))
    integral[1:, 1:] = np.cumsum(np.cumsum(strips, axis=0), axis=1)
    at = _between(xs, np.arange(w + 1), _between(ys, near, integral).T).T
    sums = np.diff(np.diff(at, axis=0), axis=1)
    return sums / (np.diff(ys)[:, None] * np.diff(xs)[None, :])


def _between(where: np.ndarray, known: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of ``rows`` (at ``known``) linearly interpolated at ``where``."""
    k = np.clip(np.searchsorted(known, where, side="right") - 1, 0, len(known) - 2)
    part = ((where - known[k]) / (known[k + 1] - known[k]))[:, None]
    return rows[k] * (1 - part) + rows[k + 1] * part


def difference_hash(image: np.ndarray) -> str:
    """64 bits, 16 hex digits: is each cell of an 8 x 9 reduction darker than the one on its right?"""
    small = area_resize(image, 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, array, allow_pickle=False)
    return out.getvalue()


def tile_hash(tile_npy: bytes) -> str:
    """The difference hash of an NPY file."""
    return difference_hash(np.lib.format.read_array(io.BytesIO(tile_npy), allow_pickle=False))


FIELDS = [
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("samples_sha256", T.StringType()),
    T.StructField("samples_bytes", T.LongType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("tile_npy", T.BinaryType()),
    T.StructField("feature", T.StringType()),
    T.StructField("error", T.StringType()),
]


def tiles(media: DataFrame, media_col: str = "media", tile: tuple[int, int] = TILE, keep: list[str] | None = None) -> DataFrame:
    """Decode each image and append the fields above: digests of the stored bytes and of the samples, and an NPY tile of
    ``tile`` cells in the samples' type."""

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            image = decode(data)
        except (ValueError, struct.error) as e:
            return (*stored, None, None, None, None, None, str(e)[:200])
        raw = image.tobytes()
        small = npy(np.rint(area_resize(image, *tile)).astype(image.dtype))
        return (*stored, hashlib.sha256(raw).hexdigest(), len(raw), zlib.crc32(raw[-64:]), small, tile_hash(small), None)

    def work(cells: list[bytes | None]) -> list[list]:
        return [list(x) for x in zip(*map(one, cells), strict=True)] if cells else [[] for _ in FIELDS]

    return map_cells(media, col(media_col), lambda: work, FIELDS, _rest(media, media_col, keep))


def _rest(media: DataFrame, media_col: str, keep: list[str] | None) -> list[str]:
    return [c for c in (media.columns if keep is None else keep) if c != media_col]


def hash_tiles(tiled: DataFrame, tile_col: str = "tile_npy", keep: list[str] | None = None) -> DataFrame:
    """``tiled`` with the difference hash of each NPY tile (``feature``), and the tile's digest (``tile_sha256``)."""

    def work(cells: list[bytes | None]) -> list[list]:
        return [[None if x is None else tile_hash(x) for x in cells], [None if x is None else hashlib.sha256(x).hexdigest() for x in cells]]

    fields = [T.StructField("feature", T.StringType()), T.StructField("tile_sha256", T.StringType())]
    return map_cells(tiled, col(tile_col), lambda: work, fields, _rest(tiled, tile_col, keep))


def store_texts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Texts as grey images 64 samples wide (P5): UTF-8 padded with zeros to a positive multiple of 64. Adds ``n_bytes``, ``media``."""

    def make():
        def work(texts: list[str]) -> list[list]:
            sizes, media = [], []
            for text in texts:
                data = text.encode("utf-8", "surrogatepass")
                height = max(1, -(-len(data) // WIDTH))
                samples = np.frombuffer(data.ljust(height * WIDTH, b"\0"), np.uint8).reshape(height, WIDTH)
                sizes.append(len(data))
                media.append(encode_pgm(samples))
            return [sizes, media]

        return work

    return map_texts(docs, text_col, make, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]), "media")
    tiled = materialise(tiles(stored, keep=["doc_id", "n_bytes"]).drop("feature", "error"), "tiles")
    return hash_tiles(tiled).select(
        "doc_id",
        "n_bytes",
        F.col("samples_bytes").alias("payload_bytes"),
        F.col("samples_sha256").alias("payload_sha256"),
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
        "tile_sha256",
    )
