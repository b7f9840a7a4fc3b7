"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing, NPY tiles, difference hashes.

Rows are independent: a null image gives null outputs, bytes that are no image of a known kind give
null outputs too, and ties, repeated rows and empty tables need no rule. Output columns replace input
columns of the same name.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftlens.llm.hashing import pieces

#: Samples in a row of a stored payload; a payload is a multiple of it.
WIDTH = 576


def _netpbm_numbers(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """n whitespace-separated numbers of a Netpbm header, comments skipped; where they end."""
    out: list[int] = []
    while len(out) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at


def read_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array: (rows, columns) or (rows, columns, 3); bits as 0 (black) and 255."""
    kind = data[1] - 48
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("not Netpbm")
    (width, height, *most), at = _netpbm_numbers(data, 2, 2 if kind in (1, 4) else 3)
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if kind == 4:
        step = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, step * height, at + 1).reshape(height, step)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]) * np.uint8(255)
    if kind == 1:
        bits = [c - 48 for c in data[at:] if c in b"01"]
        return (1 - np.array(bits[:n], np.uint8)).reshape(height, width) * np.uint8(255)
    if kind in (2, 3):
        flat = np.array(_netpbm_numbers(data + b"\n", at, n)[0], np.uint16 if most[0] > 255 else np.uint8)
    else:
        flat = np.frombuffer(data, ">u2" if most[0] > 255 else np.uint8, n, at + 1)
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def write_pgm(samples: np.ndarray) -> bytes:
    """8-bit samples (rows, columns) as binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits: (rows, columns, 3), or (rows, columns) if grey."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, head, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("not an uncompressed BMP of 8, 24 or 32 bits")
    rows, size = abs(height), bits // 8
    step = (width * size + 3) // 4 * 4
    cells = np.frombuffer(data, np.uint8, step * rows, start).reshape(rows, step)[:, : width * size]
    cells = cells if height < 0 else cells[::-1]
    if bits == 8:
        colours = (start - 14 - head) // 4
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
        return palette[:, 0][cells] if grey else palette[cells]
    return cells.reshape(rows, width, size)[:, :, 2::-1]


def write_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey samples (rows, columns) or colours (rows, columns, 3) as BMP."""
    rows, width = samples.shape[:2]
    grey = samples.ndim == 2
    cells = samples.reshape(rows, -1) if grey else samples[:, :, ::-1].reshape(rows, -1)
    step = (cells.shape[1] + 3) // 4 * 4
    body = np.zeros((rows, step), np.uint8)
    body[:, : cells.shape[1]] = cells[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4).copy() if grey else np.zeros((0, 4), np.uint8)
    palette[:, 3:] = 0
    start = 54 + palette.size
    head = b"BM" + struct.pack("<IHHI", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, rows, 1, 8 if grey else 24, 0, body.size, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + body.tobytes()


def decode_image(data: bytes | None) -> np.ndarray | None:
    """The array of a Netpbm or BMP file, or None if it is neither."""
    try:
        return None if not data else read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)
    except (ValueError, IndexError, struct.error):
        return None


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the area under each output cell, from the integral image read between its samples."""
    height, width = image.shape
    total = np.zeros((height + 1, width + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(edge: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum(edge.astype(np.int64), n - 1)
        return low, edge - low

    y, fy = at(np.linspace(0, height, rows + 1), height)
    x, fx = at(np.linspace(0, width, columns + 1), width)
    down = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    both = down[:, x] * (1 - fx) + down[:, x + 1] * fx
    cells = np.diff(np.diff(both, axis=0), axis=1)
    return cells / (height / rows * width / columns)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each cell of an 8 x 9 reduction is brighter than the one to its left."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


def _map(df: DataFrame, column: str, fields: list[T.StructField], make) -> DataFrame:
    names = {f.name for f in fields}
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in names), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column, 2 << 20):
                made = list(zip(*map(make, part.column(column).to_pylist()), strict=True)) or [()] * len(fields)
                kinds = {"binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
                new = {f.name: pa.array(v, kinds[f.dataType.simpleString()]) for f, v in zip(fields, made, strict=True)}
                yield pa.RecordBatch.from_pydict({f.name: new[f.name] if f.name in new else part.column(f.name) for f in schema.fields})

    return df.mapInArrow(run, schema)


def store_payload(df: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """`df` with each whole text's UTF-8 bytes as a grey image in `into`, without loss: one in eight, by the
    bytes' crc32, as BMP, the others as PGM.

    Bytes 255 fill the last row; an empty or null text has one row of them. `n_bytes` is the length
    without filling."""

    def make(value: str | None) -> tuple[bytes, int]:
        data = (value or "").encode("utf-8")
        rows = max(1, -(-len(data) // WIDTH))
        write = write_pgm if zlib.crc32(data) % 8 else write_bmp
        return write(np.frombuffer(data.ljust(rows * WIDTH, b"\xff"), np.uint8).reshape(rows, WIDTH)), len(data)

    return _map(df, text, [T.StructField(into, T.BinaryType()), T.StructField("n_bytes", T.LongType())], make)


def read_media(df: DataFrame, media: str = "media", tile: int = 32) -> DataFrame:
    """`df` with the decoded image's samples (`payload`), a tile x tile NPY file (`tile`), and `feature`,
    its difference hash; height and width beside them."""

    def make(data: bytes | None) -> tuple:
        image = decode_image(data)
        if image is None or not image.size:
            return None, None, None, None, None
        flat = grey(image)
        small = np.clip(np.rint(area_resize(flat, tile, tile)), 0, 255).astype(np.uint8)
        return image.tobytes(), npy(small), difference_hash(flat), image.shape[0], image.shape[1]

    fields = [T.StructField("payload", T.BinaryType()), T.StructField("tile", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType())]
    return _map(df, media, fields, make)
