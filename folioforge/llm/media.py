"""Operator 4: media columns. Netpbm and BMP to arrays, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table, with_columns

UNIT, WIDTH, FILL = 576, 24, 255


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    out, at = [], 2
    while len(out) < fields:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            end = data.find(b"\n", at)
            at = len(data) if end < 0 else end + 1
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as height x width x channels, uint8, or uint16 for a maximum over 255; P1 and P4 give 0 for black, 255 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap = kind in (b"P1", b"P4")
    head, at = _netpbm_header(data, 2 if bitmap else 3)
    w, h, most = head[0], head[1], 1 if bitmap else head[2]
    if not (w > 0 and h > 0 and 0 < most < 65536):
        raise ValueError("bad Netpbm size")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * channels
    if kind == b"P1":
        bits = np.frombuffer(data, np.uint8, offset=at)
        a = bits[(bits == 48) | (bits == 49)][:n] - 48
    elif kind in (b"P2", b"P3"):
        a = np.array(data[at:].split()[:n], dtype=np.int64)
    elif kind == b"P4":
        row = (w + 7) // 8
        a = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w]
    else:
        a = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if a.size != n:
        raise ValueError("short Netpbm data")
    if bitmap:
        a = np.where(a, 0, 255)
    return a.reshape(h, w, channels).astype(np.uint16 if most > 255 else np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as height x width x channels, uint8; a grey palette gives one channel."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    offset, head, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if head < 40 or packed not in (0, 3) or w <= 0 or h == 0 or depth not in (1, 4, 8, 24, 32):
        raise ValueError("unsupported BMP")
    rows, stride = abs(h), (w * depth + 31) // 32 * 4
    a = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    if h > 0:
        a = a[::-1]
    if depth in (24, 32):
        return np.ascontiguousarray(a[:, : w * depth // 8].reshape(rows, w, depth // 8)[:, :, 2::-1])
    used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
    if depth == 8:
        index = a[:, :w]
    else:
        bits = np.unpackbits(a, axis=1)
        index = bits[:, :w] if depth == 1 else (bits.reshape(rows, -1, 4) * np.array([8, 4, 2, 1], np.uint8)).sum(2, dtype=np.uint8)[:, :w]
    grey = (palette == palette[:, :1]).all()
    return np.ascontiguousarray((palette[:, :1] if grey else palette)[index])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, rows bottom up and padded to 4 bytes."""
    h, w = samples.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = samples[::-1]
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    grey[:, 3] = 0
    size = 54 + 1024 + rows.size
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", size, 0, 0, 1078, 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + grey.tobytes() + rows.tobytes()


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the area of each new pixel, exact for fractional edges, from the integral image. Channels stay."""
    h, w = a.shape[:2]
    total = np.zeros((h + 1, w + 1) + a.shape[2:], np.float64)
    np.cumsum(np.cumsum(a, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def at(axis: int, n: int, size: int, x: np.ndarray) -> np.ndarray:
        edge = np.arange(size + 1) * (n / size)
        low = np.minimum(edge.astype(int), n - 1)
        part = (edge - low).reshape([-1 if k == axis else 1 for k in range(x.ndim)])
        return np.take(x, low, axis) * (1 - part) + np.take(x, low + 1, axis) * part

    edges = at(1, w, width, at(0, h, height, total))
    return np.diff(np.diff(edges, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(a: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 area means is below its right neighbour; channels are averaged first."""
    small = area_resize(a.mean(2) if a.ndim == 3 else a, 8, 9)
    return int.from_bytes(np.packbits(small[:, :-1] + 1e-9 < small[:, 1:]).tobytes(), "big")


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def tile(a: np.ndarray, size: int) -> bytes:
    """The image area-resized to size x size, rounded, as NPY bytes of its own sample type."""
    return npy(np.rint(area_resize(a, size, size)).astype(a.dtype))


def media_tiles(df: DataFrame, image: str = "image", size: int = 24) -> DataFrame:
    """df with media_height, media_width, media_channels, media_tile (NPY), media_hash (16 hex digits), media_error.

    Null or undecodable bytes give nulls and the reason in media_error; the row stays. Other columns pass through;
    columns of these names are replaced. Equal bytes give equal values.
    """

    def one(data) -> tuple:
        if data is None:
            return None, None, None, None, None, "null"
        try:
            a = decode(bytes(data))
        except (ValueError, IndexError, struct.error) as e:
            return None, None, None, None, None, str(e) or "undecodable"
        return (*a.shape, tile(a, size), f"{difference_hash(a):016x}", None)

    fields = "media_height int, media_width int, media_channels int, media_tile binary, media_hash string, media_error string"
    return with_columns(df, image, lambda: lambda images: _columns([one(x) for x in images], 6), fields)


def _columns(rows: list[tuple], width: int) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(width)]


def payload(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return data + bytes([FILL]) * (size - len(data))


def digest(text: str | None) -> tuple:
    """The text's bytes stored as a PGM of 24 columns, read back from that form, and the features of what was read."""
    whole = payload(text)
    stored = encode_pgm(np.frombuffer(whole, np.uint8).reshape(-1, WIDTH))
    a = decode(stored)
    back = a.tobytes()
    feature = f"{difference_hash(a):016x}:{hashlib.sha256(tile(a, WIDTH)).hexdigest()[:16]}"
    n = len((text or "").encode("utf-8", "surrogatepass"))
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def text_media(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the id and the digest of the text's stored form. A null text is an empty one."""
    rows = df.selectExpr(f"`{id_col}` AS doc_id", f"coalesce(`{text}`, '') AS media_text")
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return with_columns(rows, "media_text", lambda: lambda texts: _columns([digest(x) for x in texts], 7), fields).drop("media_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
