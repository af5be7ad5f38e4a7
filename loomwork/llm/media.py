"""Media columns: Netpbm and BMP to numpy arrays, area-resized by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomwork.llm.common import SLICE_ROWS, map_texts
from loomwork.session import shared_dir

_HEADER = re.compile(rb"(P[1-6])" + rb"(?:\s|#[^\n]*\n)+(\d+)" + rb"(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?")


def encode_netpbm(samples: np.ndarray) -> bytes:
    """P5 of a (height, width) array of uint8, P6 of a (height, width, 3) one."""
    kind = b"P6" if samples.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + samples.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with up to 8 bits a sample: (height, width) or (height, width, 3) uint8; bitmaps give 0 and 255."""
    kind = data[:2]
    bitmap = kind in (b"P1", b"P4")
    m = re.match(_HEADER.pattern.rsplit(rb"(?:(?:", 1)[0], data) if bitmap else _HEADER.match(data)
    if not m:
        raise ValueError("not a Netpbm image")
    width, height, channels = int(m[2]), int(m[3]), 3 if kind in (b"P3", b"P6") else 1
    if not bitmap and not 0 < int(m[4]) < 256:
        raise ValueError("more than 8 bits a sample")
    body = data[m.end() + 1 :]
    if kind == b"P4":
        rows = np.frombuffer(body, np.uint8, height * ((width + 7) // 8)).reshape(height, -1)
        return np.where(np.unpackbits(rows, axis=1)[:, :width], 0, 255).astype(np.uint8)
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", body), np.uint8)[: width * height] - 48
        return np.where(bits, 0, 255).astype(np.uint8).reshape(height, width)
    if kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n]*\n", b" ", body).split()[: width * height * channels], dtype=np.uint8)
    else:
        flat = np.frombuffer(body, np.uint8, width * height * channels)
    return flat.reshape((height, width, 3) if channels == 3 else (height, width))


def encode_bmp(samples: np.ndarray) -> bytes:
    """24-bit BMP of a (height, width, 3) uint8 array."""
    height, width, _ = samples.shape
    stride = (3 * width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = samples[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + head + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (by its palette), 24 or 32 bits: (height, width, 3) uint8, top row first."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("a BMP of this kind isn't read")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)
        return palette[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


#: Samples whose sums are held at once.
BLOCK_SAMPLES = 1 << 18


def integral_lines(gray: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted lines, which rise, of the integral image: line k holds the sums of the first k rows. Rows are read in blocks."""
    out = np.zeros((len(wanted), gray.shape[1] + 1))
    above, step, at = np.zeros(gray.shape[1]), max(1, BLOCK_SAMPLES // max(1, gray.shape[1])), 0
    for first in range(0, gray.shape[0], step):
        sums = gray[first : first + step].cumsum(axis=0, dtype=np.float64) + above
        until = np.searchsorted(wanted, first + len(sums), side="right")
        rows = wanted[at:until] - first - 1
        out[at:until, 1:] = np.where((rows >= 0)[:, None], sums[rows], 0)
        above, at = sums[-1], until
    return out.cumsum(axis=1)


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal rectangles, fractions of pixels included, from differences of the integral image."""
    ys, xs = np.linspace(0, gray.shape[0], height + 1), np.linspace(0, gray.shape[1], width + 1)
    low = np.minimum(ys.astype(np.int64), gray.shape[0] - 1)
    wanted, place = np.unique(np.concatenate([low, low + 1]), return_inverse=True)
    table = integral_lines(gray, wanted)[place]
    part = (ys - low).reshape(-1, 1)
    lines = table[: height + 1] * (1 - part) + table[height + 1 :] * part
    left = np.minimum(xs.astype(np.int64), gray.shape[1] - 1)
    corners = lines[:, left] * (1 - (xs - left)) + lines[:, left + 1] * (xs - left)
    area = gray.shape[0] / height * (gray.shape[1] / width)
    return np.diff(np.diff(corners, axis=0), axis=1) / area


def to_gray(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else samples.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def difference_hash(gray: np.ndarray) -> str:
    """16 hex digits: whether each cell of an 8 x 9 reduction is brighter than its left neighbour."""
    small = np.round(area_resize(gray, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(gray: np.ndarray, side: int = 16) -> bytes:
    """The image reduced to side x side samples of 8 bits, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.floor(area_resize(gray, side, side) + 0.5).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


_FILES = "n_bytes long, media binary, tile binary"
_FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string, tile_side int"


def write_media(docs: DataFrame, folder: str, unit: int = 576, width: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes (id, n_bytes, media, tile) to a Parquet table, and returns it reread: each text's UTF-8 bytes, padded with 255 to a positive
    multiple of unit, as a PGM image of width samples a row, and its NPY tile, as bytes that np.load reads.

    A row stands for two files: files of a few hundred bytes each would be as many as documents. A null or empty text is `unit` bytes of padding;
    texts of any length are stored whole; repeated rows are stored as often; an empty table is an empty one.
    """

    def start():
        def work(text: str) -> list[tuple]:
            data = text.encode("utf-8", "replace")
            payload = data + b"\xff" * (-len(data) % unit if data else unit)
            samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
            return [(len(data), encode_netpbm(samples), npy_tile(samples))]

        return work

    map_texts(docs, id_col, text_col, _FILES, start).write.parquet(folder)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.sparkSession.read.schema(f"`{id_col}` {kind}, {_FILES}").parquet(folder)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tile_sha256, tile_side) of write_media's table.

    All but n_bytes comes from the stored bytes: payload is the image decoded, feature its difference hash, and the tile is read by np.load.
    """
    out = T.StructType([T.StructField(id_col, media.schema[id_col].dataType), *T.StructType.fromDDL(_FEATURES).fields])
    arrow = to_arrow_schema(out)

    def features(n: int, stored: bytes, tile: bytes) -> tuple:
        samples = decode(stored)
        read = samples.tobytes()
        small = np.load(io.BytesIO(tile), allow_pickle=False)
        return n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(to_gray(samples)), hashlib.sha256(tile).hexdigest(), small.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = [features(*(part.column(c)[i].as_py() for c in (1, 2, 3))) for i in range(part.num_rows)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return media.select(F.col(f"`{id_col}`"), "n_bytes", "media", "tile").mapInArrow(run, out)


def text_media(docs: DataFrame, folder: str | None = None, unit: int = 576, width: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_features of write_media: the texts stored in a folder, by default a new one in the shared scratch folder, reread, and measured.

    Equal texts give equal rows but for the id. Further columns, of any name, are not read.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/loomwork/media-{uuid.uuid4().hex}"
    return media_features(write_media(docs, folder, unit, width, id_col, text_col), id_col)
