"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of the resized image, and of a tile cut from it.
THUMB, TILE = 32, 16
#: Bytes of a stored payload's row; payloads are padded to a multiple of it.
ROW = 64

_TOKEN = re.compile(rb"(?:[ \t\r\n\v\f]|#[^\r\n]*)*([^ \t\r\n\v\f#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array (rows, columns) or (rows, columns, 3): booleans for bitmaps, uint8 or uint16 else."""
    m = re.match(rb"P([1-6])", data)
    if not m:
        raise ValueError("not a Netpbm image")
    kind, at, head = int(m[1]), 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        if not (t := _TOKEN.match(data, at)):
            raise ValueError("the header ends early")
        head.append(int(t[1]))
        at = t.end()
    width, height, top = head[0], head[1], (head + [1])[2]
    depth = 3 if kind in (3, 6) else 1
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise ValueError("bad header")
    n, dtype = width * height * depth, np.dtype(">u2" if top > 255 else "u1")
    if n > 8 * len(data):  # a sample takes a bit at least
        raise ValueError("samples are missing")
    if kind == 1:
        bits = re.sub(rb"#[^\r\n]*|[^01]", b"", data[at:])
        out = np.frombuffer(bits[:n], "u1") == ord("1")
    elif kind in (2, 3):
        out = np.array(re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:n], dtype="i8")
        if out.size and not 0 <= out.min() <= out.max() <= top:
            raise ValueError("a sample is over the maximum")
        out = out.astype(dtype)
    elif kind == 4:
        stride = -(-width // 8)
        rows = np.frombuffer(data, "u1", stride * height, at + 1).reshape(height, stride)
        return np.unpackbits(rows, axis=1)[:, :width].astype(bool)
    else:
        out = np.frombuffer(data, dtype, n, at + 1)
        if out.max() > top:
            raise ValueError("a sample is over the maximum")
    if out.size != n:
        raise ValueError("samples are missing")
    out = out.astype(dtype.newbyteorder("=")) if out.dtype != bool else out
    return out.reshape((height, width, depth) if depth > 1 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel as uint8 (rows, columns, 3), or (rows, columns) if its palette is grey."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, header, width, height, _, bits, method = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0]
    if header < 40 or method not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width < 1 or height == 0:
        raise ValueError("this kind of BMP is not supported")
    stride = -(-width * bits // 32) * 4
    if stride * abs(height) > len(data):
        raise ValueError("pixels are missing")
    rows = np.frombuffer(data, "u1", stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1])
    if bits < 8:
        index = np.unpackbits(rows, axis=1).reshape(rows.shape[0], -1, bits)
        index = (index << np.arange(bits - 1, -1, -1, dtype="u1")).sum(axis=2, dtype="u1")[:, :width]
    else:
        index = rows[:, :width]
    n = colours or 1 << bits
    palette = np.frombuffer(data, "u1", 4 * n, 14 + header).reshape(n, 4)[:, 2::-1]
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][index] if grey else palette[index]


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + np.ascontiguousarray(samples, "u1").tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image.mean(axis=2) if image.ndim == 3 else image


def area_resize(images: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean over each target cell's exact area, from the integral image; shape (..., rows, columns) in doubles."""
    h, w = images.shape[-2:]
    total = np.zeros((*images.shape[:-2], h + 1, w + 1))
    np.cumsum(np.cumsum(images, axis=-2, dtype="f8"), axis=-1, out=total[..., 1:, 1:])

    def at(a: np.ndarray, n: int, axis: int) -> np.ndarray:
        size = a.shape[axis] - 1
        x = np.arange(n + 1) * (size / n)
        low = np.minimum(x.astype("i8"), size - 1)
        part = (x - low).reshape((-1, 1) if axis == -2 else -1)
        first = a.take(low, axis)
        return np.diff(first + (a.take(low + 1, axis) - first) * part, axis=axis)

    return at(at(total, rows, -2), columns, -1) / (h / rows * (w / columns))


def difference_hash(images: np.ndarray) -> np.ndarray:
    """64 bits an image (uint64): whether each of 8 x 8 cells is darker than the one to its right."""
    small = np.round(area_resize(images, 8, 9), 6)
    bits = small[..., :-1] < small[..., 1:]
    return np.packbits(bits.reshape(*bits.shape[:-2], 64), axis=-1).view(">u8")[..., 0].astype("u8")


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, array, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def read_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def tiles(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The image resized to THUMB x THUMB and cut: uint8 (tiles, TILE, TILE), row by row, and their hashes."""
    small = np.clip(np.rint(area_resize(grey(image), THUMB, THUMB)), 0, 65535)
    k = THUMB // TILE
    cut = small.reshape(k, TILE, k, TILE).swapaxes(1, 2).reshape(k * k, TILE, TILE)
    return cut.astype("u1" if cut.max(initial=0) < 256 else "u2"), difference_hash(cut)


SCHEMA = "id {id}, media_bytes long, height int, width int, channels int, hash string, tiles array<struct<npy:binary,hash:string>>, error string"


def media_features(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, media_bytes, height, width, channels, hash, tiles, error) for a binary column of Netpbm or BMP files.

    tiles: the area-resized image cut into NPY tiles, each with its difference hash. Null or broken media give
    nulls and the reason in error; repeated rows are decoded each; other columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = {"id": key, "media_bytes": None if data is None else len(data)}
                try:
                    if data is None:
                        raise ValueError("null")
                    image = decode(data)
                    cut, hashes = tiles(image)
                    row |= {"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2] if image.ndim == 3 else 1, "hash": f"{int(difference_hash(grey(image))):016x}", "tiles": [{"npy": npy(t), "hash": f"{int(h):016x}"} for t, h in zip(cut, hashes, strict=True)]}
                except (ValueError, OverflowError, struct.error, IndexError) as e:
                    row["error"] = str(e)
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(SCHEMA.format(id=kind)))
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, SCHEMA.format(id=kind)).withColumnRenamed("id", id_col)


def store_text(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and a grey image whose samples are its bytes, padded with 0 to whole rows."""
    raw = (text or "").encode()
    n = max(ROW, -(-len(raw) // ROW) * ROW)
    return len(raw), encode_pgm(np.frombuffer(raw.ljust(n, b"\0"), "u1").reshape(-1, ROW))


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text as an image, read it back and hash what was read.

    Returns id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tiles and, if
    asked for, media. tiles: the area-resized image as NPY files. feature: the image's difference hash and those of the
    tiles, as read from these files, in hex. Null and empty texts are one row of zeros; equal texts get equal values
    whatever their id; repeated rows and null ids stay rows; other columns are left out; an empty table stays empty.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tiles array<binary>"
    schema += ", media binary" if with_media else ""

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1):
                n, stored = store_text(text.as_py())
                image = decode(stored)
                payload = image.tobytes()
                written = [npy(t) for t in tiles(image)[0]]
                hashes = difference_hash(np.stack([read_npy(t) for t in written]))
                feature = f"{int(difference_hash(image)):016x}:" + "".join(f"{int(h):016x}" for h in hashes)
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, written, *[stored] * with_media))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * (len(target) - 1), target.types[1:], strict=True)]], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op1_media(spark, sf_dir):
    from .common import documents

    return text_media(documents(spark, sf_dir))
