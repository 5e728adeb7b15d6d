"""Contents of image files: capture metadata, decoding to pixels, encoding.

``image_files`` reads and writes the files.  PNG is decoded and encoded here; other formats need an installed
decoder (``PIL``), without which their files are an error, not a gap in the result.  Metadata are read from JPEG and PNG alike.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import ENDINGS as ENDINGS

# Tags and value types of the metadata block, and the columns they go to.
TAGS = {0x010F: "make", 0x0110: "model", 0x829A: "exposure_time", 0x829D: "f_number", 0x8827: "iso", 0x9201: "shutter_speed_value", 0x9202: "aperture_value", 0x9204: "bias"}
SUB_DIRECTORY, SIZES = 0x8769, {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
PNG = b"\x89PNG\r\n\x1a\n"

TEXTS = ("make", "model")
FRAMES = "path string, width int, height int, exposure_time double, f_number double, iso double, shutter_speed_value double, aperture_value double, bias double, make string, model string, exif binary"
PIXELS = "path string, y int, x int, r int, g int, b int"


def exif_values(block: bytes) -> dict:
    """The known tags of a metadata block; of lists the first element, of a zero denominator nothing."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        return {}
    out: dict = {}

    def directory(at: int) -> None:
        if at + 2 > len(block):
            return
        for i in range(struct.unpack_from(f"{order}H", block, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(block):
                return
            tag, kind, count = struct.unpack_from(f"{order}HHI", block, entry)
            size = SIZES.get(kind, 0) * count
            place = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", block, entry + 8)[0]
            if not size or place + size > len(block):
                continue
            if tag == SUB_DIRECTORY:
                directory(struct.unpack_from(f"{order}I", block, entry + 8)[0])
            elif tag in TAGS and kind == 2:
                out[TAGS[tag]] = block[place : place + size].split(b"\0")[0].decode("utf-8", "replace").strip()
            elif tag in TAGS and kind in (5, 10):
                a, b = struct.unpack_from(f"{order}{'II' if kind == 5 else 'ii'}", block, place)
                if b:
                    out[TAGS[tag]] = a / b
            elif tag in TAGS and kind in (3, 4):
                out[TAGS[tag]] = float(struct.unpack_from(f"{order}{'H' if kind == 3 else 'I'}", block, place)[0])

    directory(struct.unpack_from(f"{order}I", block, 4)[0])
    return out


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def described(data: bytes) -> tuple[int | None, int | None, bytes | None]:
    """Width, height and metadata block of a PNG or JPEG file."""
    width = height = block = None
    if data.startswith(PNG):
        for kind, body in _chunks(data):
            if kind == b"IHDR":
                width, height = struct.unpack_from(">II", body)
            elif kind == b"eXIf":
                block = body
    elif data.startswith(b"\xff\xd8"):
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if marker == 0xE1 and body.startswith(b"Exif\0\0"):
                block = body[6:]
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", body, 1)
            if marker == 0xDA:
                break
            at += 2 + size
    return width, height, block


def decoded(data: bytes) -> np.ndarray:
    """Bytes (height, width, 3)."""
    if not data.startswith(PNG):
        try:
            from PIL import Image
        except ImportError as e:
            raise ValueError("only PNG files are decoded without PIL") from e
        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    parts = list(_chunks(data))
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", next(b for k, b in parts if k == b"IHDR"))
    if depth != 8 or interlaced or colour not in (0, 2, 4, 6):
        raise ValueError("only PNG files of eight bits, without palette and interlacing, are decoded")
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT")), np.uint8).reshape(height, 1 + width * n)
    pixels = _unfiltered(raw[:, 0], raw[:, 1:].reshape(height, width, n))
    return pixels[..., :3] if n > 2 else np.repeat(pixels[..., :1], 3, axis=2)


def _unfiltered(kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Pixels from lines that are told as they are (0), or as differences to the pixel on the left (1), above (2), to the mean of both (3), or to
    the nearest of left, above and corner (4)."""
    height, width, n = raw.shape
    if kinds.max(initial=0) < 3:
        out = np.zeros_like(raw)
        for y, kind in enumerate(kinds.tolist()):
            out[y] = raw[y] if kind == 0 else np.cumsum(raw[y], axis=0, dtype=np.uint8) if kind == 1 else raw[y] + (out[y - 1] if y else 0)
        return out
    # pixels of one diagonal depend on earlier diagonals alone, so all of them are found at once; a border of zeros stands above and on the left
    out = np.zeros((height + 1, width + 1, n), np.int32)
    kind = kinds.astype(np.int32)[:, None]
    for t in range(width + height - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x = t - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        k = kind[y]
        guess = np.where(k == 4, nearest, np.where(k == 3, (a + b) // 2, np.where(k == 2, b, np.where(k == 1, a, 0))))
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


class Encoder:
    """A PNG file from the lines of an image as they come; what is held is compressed."""

    def __init__(self, width: int, height: int, exif: bytes | None = None) -> None:
        self.head, self.wide, self.left = (width, height, exif), 3 * width, b""
        self.packer, self.body = zlib.compressobj(6), []

    def add(self, data: bytes) -> None:
        """Further samples; lines need not end with them."""
        self.left += data
        whole = len(self.left) // self.wide * self.wide
        for i in range(0, whole, self.wide):
            self.body.append(self.packer.compress(b"\0" + self.left[i : i + self.wide]))
        self.left = self.left[whole:]

    def end(self) -> bytes:
        width, height, exif = self.head
        self.body.append(self.packer.flush())
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", b"".join(self.body)) + chunk(b"IEND", b"")


def encoded(lines: Iterator[bytes], width: int, height: int, exif: bytes | None = None) -> bytes:
    """A PNG file from the lines of an image."""
    encoder = Encoder(width, height, exif)
    for line in lines:
        encoder.add(line)
    return encoder.end()


def described_rows(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
    """One row: size, capture metadata and the raw metadata block; tags that are missing are null."""
    names = [c.split(" ")[0] for c in FRAMES.split(", ")]
    width, height, block = described(content)
    known = exif_values(block or b"")
    row = {"path": path, "width": width, "height": height, "exif": block, **{t: known.get(t) for t in TAGS.values()}}
    kinds = [pa.binary() if x == "exif" else pa.int32() if x in ("width", "height") else pa.string() if x in ("path", *TEXTS) else pa.float64() for x in names]
    yield pa.RecordBatch.from_arrays([pa.array([row[x]], t) for x, t in zip(names, kinds, strict=True)], names=names)


def pixel_rows(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
    """path, y, x, r, g, b, a block of lines at a time."""
    image = decoded(content)
    h, w, _ = image.shape
    block = max(1, 100_000 // w)
    for y in range(0, h, block):
        part = image[y : y + block]
        ys, xs = np.divmod(np.arange(len(part) * w, dtype=np.int32), w)
        channels = [pa.array(part[..., c].ravel().astype(np.int32)) for c in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(xs)), pa.array((ys + y).astype(np.int32)), pa.array(xs.astype(np.int32)), *channels], names=["path", "y", "x", "r", "g", "b"])


def encode(df: DataFrame, key: str = "image_id", exif: DataFrame | None = None) -> DataFrame:
    """key and PNG content of each image of bytes (key, y, x, r, g, b).  Images are sorted, then written line by line, so a task
    holds one compressed image.  ``exif`` (key, exif) gives metadata blocks that are copied to the images."""
    df = df.select(key, "y", "x", "r", "g", "b")
    sizes = df.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    sizes = sizes.join(exif.select(key, "exif"), key, "left") if exif is not None else sizes.withColumn("exif", F.lit(None).cast("binary"))
    rows = df.join(sizes, key).repartition(key).sortWithinPartitions(key, "y", "x")
    kind = dict(df.dtypes)[key]

    def scan(batches):
        now, encoder = None, None

        def ended():
            return pa.RecordBatch.from_pydict({key: [now], "content": [encoder.end()]})

        for batch in batches:
            keys = batch.column(key).to_pylist()
            data = np.stack([batch.column(c).to_numpy() for c in "rgb"], 1).astype(np.uint8)
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if encoder is None or keys[a] != now:
                    if encoder is not None:
                        yield ended()
                    now, encoder = keys[a], Encoder(*(batch.column(c)[a].as_py() for c in ("w", "h", "exif")))
                encoder.add(data[a:b].tobytes())
        if encoder is not None:
            yield ended()

    return rows.mapInArrow(scan, f"`{key}` {kind}, content binary")
