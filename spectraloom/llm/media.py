"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles and difference hashes.

Decoders return (rows, columns, channels) arrays of 8-bit samples. Resizing averages
areas exactly, from integral images in 64-bit integers. Tiles are NPY files in a
binary column.

Defined results: a null text is the empty one; null media give null tiles and hashes;
what is not a whole image of a known kind gives these and the reason as error (the
decoders alone raise ValueError); an empty table gives an empty result; rows with one
id are stored one by one. Images are worked on a few at a time, by their bytes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import documents, materialize

#: Bytes of a row of a stored image: 64 pixels of three samples.
ROW = 192
#: Bytes of texts or images that are worked on at once; a larger one is a batch of its own.
TOGETHER = 16 << 20


def batches_of(batches, column: str):
    """Batches cut so that a column has about TOGETHER bytes in each."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + TOGETHER, side="right")))
            yield batch.slice(row, end - row)
            row = end


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6. Samples are scaled to 0-255 where the largest value is another; P1 and P4 give 0 for black."""
    if len(data) < 2 or data[:1] != b"P" or data[1:2] not in b"123456":
        raise ValueError("not a Netpbm image")
    kind, at, fields = data[1] - 48, 2, []
    while len(fields) < (2 if kind in (1, 4) else 3):
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            at = data.find(b"\n", at) + 1 or len(data) if data[at] == 35 else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        fields.append(int(data[at:end]))
        at = end
    width, height, top = (*fields, 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    if kind <= 3:
        text = data[at:] if kind > 1 else b" ".join(data[at:].split()).replace(b"0", b" 0 ").replace(b"1", b" 1 ")
        samples = np.array(text.split()[:count], dtype=np.int64)
    elif kind == 4:
        stride = -(-width // 8)
        raw = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        samples = np.unpackbits(raw, axis=1)[:, :width].astype(np.int64).ravel()
    else:
        samples = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count, at + 1)
    if len(samples) != count:
        raise ValueError("Netpbm image is cut short")
    if kind in (1, 4):
        samples = (1 - samples) * 255
    elif top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    return samples.astype(np.uint8).reshape(height, width, channels)


def encode_ppm(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + pixels.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits, top-down or bottom-up, as RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, header, width, height, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if packed not in (0, 3) or bits not in (8, 24, 32) or width <= 0:
        raise ValueError("unknown kind of BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if len(data) < start + stride * rows:
        raise ValueError("BMP image is cut short")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits == 8:
        colours = (struct.unpack_from("<I", data, 46)[0]) or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        pixels = palette[raw[:, :width]]
    else:
        pixels = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(pixels if height < 0 else pixels[::-1])


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24 bits, bottom-up."""
    height, width, _ = pixels.shape
    stride = (width * 3 + 3) // 4 * 4
    raw = np.zeros((height, stride), np.uint8)
    raw[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + raw.size, 0, 0, 54, 40, width, height, 1, 24, 0, raw.size, 2835, 2835, 0, 0)
    return head + raw.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the exact area of each target pixel, rounded half up.

    The integral image at fractional places is interpolated; coordinates are scaled
    by the target size, so that all sums are whole numbers.
    """
    rows, cols, channels = pixels.shape

    def along(x: np.ndarray, size: int, target: int) -> np.ndarray:
        total = np.zeros((size + 1, *x.shape[1:]), np.int64)
        np.cumsum(x, axis=0, out=total[1:])
        edge = np.arange(target + 1) * size
        whole, part = edge // target, edge % target
        at = total[whole] * target
        inside = part > 0
        at[inside] += x[whole[inside]] * part[inside].reshape(-1, *[1] * (x.ndim - 1))
        return np.diff(at, axis=0)

    by_row = along(pixels.astype(np.int64), rows, height)
    both = along(by_row.transpose(1, 0, 2), cols, width).transpose(1, 0, 2)
    area = rows * cols
    return ((2 * both + area) // (2 * area)).astype(np.uint8)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma in whole numbers: (299 R + 587 G + 114 B) / 1000, rounded."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    weighed = pixels[:, :, :3].astype(np.int64) @ np.array([299, 587, 114])
    return ((weighed + 500) // 1000).astype(np.uint8)


def difference_hash(pixels: np.ndarray, side: int = 8) -> str:
    """side * side bits in hexadecimal: whether grey grows from each cell to the right one, over a grid of side rows and side + 1 columns."""
    cells = area_resize(grey(pixels)[:, :, None], side, side + 1)[:, :, 0]
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def to_npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, pixels, allow_pickle=False)
    return out.getvalue()


def tile_columns(df: DataFrame, media_col: str = "media", height: int = 16, width: int = 16) -> DataFrame:
    """df and tile (NPY bytes), dhash, the image's height and width, and error (null for whole images); with "_" before, where df has such a name."""
    added = ["tile", "dhash", "height", "width", "error"]
    while set(added) & set(df.columns):
        added = ["_" + a for a in added]
    kinds = [T.BinaryType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.StringType()]

    def one(media) -> tuple:
        if not media.is_valid:
            return (None,) * 5
        try:
            pixels = decode(media.as_buffer().to_pybytes())
            return to_npy(area_resize(pixels, height, width)), difference_hash(pixels), *pixels.shape[:2], None
        except (ValueError, IndexError, struct.error) as e:
            return None, None, None, None, str(e) or type(e).__name__

    def run(batches):
        for batch in batches_of(batches, media_col):
            rows = list(zip(*map(one, batch.column(media_col))))
            arrays = [pa.array(v, k) for v, k in zip(rows, (pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *added])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(a, k) for a, k in zip(added, kinds)]]))


def text_image(payload: bytes) -> bytes:
    """A payload of whole rows as an image: PPM or BMP, by its checksum."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    return encode_bmp(pixels) if zlib.crc32(payload) & 1 else encode_ppm(pixels)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the written table (doc_id, n_bytes, media, tile)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches_of(batches, "text"):
            sizes, media, tiles = [], [], []
            for text in batch.column("text"):
                n, payload = padded(text.as_py())
                image = text_image(payload)
                sizes.append(n)
                media.append(image)
                tiles.append(to_npy(area_resize(decode(image), 16, 16)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(tiles, pa.binary())], names=["doc_id", "n_bytes", "media", "tile"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary, tile binary"), "media")


def media_features(stored: DataFrame) -> DataFrame:
    """Reads images and tiles back: digests of payload and stored form, and the feature, "dhash:digest" of the image and of its tile's samples."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches_of(batches, "media"):
            rows = []
            for media, tile in zip(batch.column("media"), batch.column("tile")):
                image = media.as_py()
                pixels = decode(image)
                payload = pixels.tobytes()
                small = np.load(io.BytesIO(tile.as_py()), allow_pickle=False)
                feature = f"{difference_hash(pixels)}:{hashlib.sha256(small.tobytes()).hexdigest()[:16]}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    return stored.select("doc_id", "n_bytes", "media", "tile").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_texts(documents(spark, sf_dir)))
