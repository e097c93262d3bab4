"""Image analysis: figures, dominant colours, transparency and camera data of image files.

``analysed`` takes files (path, content), such as Spark's binaryFile source gives, and
returns one row per file. Images are decoded by Pillow where it is installed, else by a
small PNG reader; a file that cannot be read gets its size, its hash and an error.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators.media import dominant_colours, has_transparency, palette_shares

#: The camera fields that are kept, by tag number.
EXIF_TAGS = {256: "ImageWidth", 257: "ImageLength", 271: "Make", 272: "Model", 306: "DateTime"}
#: Colour types of PNG with their mode and channels.
PNG_MODES = {0: ("L", 1), 2: ("RGB", 3), 3: ("P", 1), 4: ("LA", 2), 6: ("RGBA", 4)}
PNG_START = b"\x89PNG\r\n\x1a\n"


class Image(NamedTuple):
    format: str
    mode: str
    rgb: np.ndarray  # height, width, 3
    alpha: np.ndarray | None  # height, width


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """PNG scan lines without their filters."""
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            now = line.copy()
        elif kind == 1:
            now = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = line + above
        elif kind in (3, 4):
            now = np.zeros(stride, np.uint8)
            for x in range(stride):
                a, b, c = (int(now[x - step]) if x >= step else 0), int(above[x]), (int(above[x - step]) if x >= step else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
                now[x] = (int(line[x]) + guess) & 255
        else:
            raise ValueError(f"unknown filter {kind}")
        out[y] = above = now
    return out


def read_png(content: bytes, most_pixels: int = 50_000_000) -> Image:
    """A PNG of eight bits a channel, not interlaced."""
    if not content.startswith(PNG_START):
        raise ValueError("not a PNG")
    at, parts = len(PNG_START), {}
    while at + 8 <= len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        parts.setdefault(name, []).append(content[at + 8 : at + 8 + size])
        at += size + 12
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    if depth != 8 or interlaced or colour not in PNG_MODES or width * height > most_pixels:
        raise ValueError("this kind of PNG needs Pillow")
    mode, step = PNG_MODES[colour]
    raw = zlib.decompressobj().decompress(b"".join(parts[b"IDAT"]), height * (width * step + 1))
    pixels = _unfiltered(raw, height, width * step, step).reshape(height, width, step)
    alpha = None
    if mode == "P":
        palette = np.frombuffer(parts[b"PLTE"][0], np.uint8).reshape(-1, 3)
        rgb = palette[pixels[:, :, 0]]
    else:
        rgb = pixels[:, :, :3] if step >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)
        alpha = pixels[:, :, -1] if step in (2, 4) else None
    return Image("PNG", mode, rgb, alpha)


def read_image(content: bytes) -> Image:
    try:
        from PIL import Image as Pillow
    except ImportError:
        return read_png(content)
    with Pillow.open(io.BytesIO(content)) as im:
        alpha = np.asarray(im.getchannel("A")) if im.mode in ("RGBA", "LA") else None
        return Image(im.format or "", im.mode, np.asarray(im.convert("RGB")), alpha)


def exif(content: bytes) -> dict[str, str]:
    """The camera fields of a JPEG file that has them."""
    at = content.find(b"Exif\x00\x00", 0, 65_536)
    if not content.startswith(b"\xff\xd8") or at < 0:
        return {}
    tiff = content[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return {}
    first = struct.unpack(f"{order}I", tiff[4:8])[0]
    out = {}
    for i in range(struct.unpack(f"{order}H", tiff[first : first + 2])[0]):
        entry = tiff[first + 2 + 12 * i : first + 14 + 12 * i]
        tag, kind, n = struct.unpack(f"{order}HHI", entry[:8])
        if tag in EXIF_TAGS:
            if kind == 2:
                start = struct.unpack(f"{order}I", entry[8:])[0]
                text = entry[8 : 8 + n] if n <= 4 else tiff[start : start + n]
                out[EXIF_TAGS[tag]] = text.split(b"\x00")[0].decode("utf-8", "replace")
            elif kind in (3, 4):
                out[EXIF_TAGS[tag]] = str(struct.unpack(f"{order}{'H' if kind == 3 else 'I'}", entry[8 : 10 if kind == 3 else 12])[0])
    return out


def thumbnail(rgb: np.ndarray, side: int = 100) -> np.ndarray:
    """Pixels of a grid of ``side`` by ``side`` places."""
    y, x = (np.arange(side) * n // side for n in rgb.shape[:2])
    return rgb[y][:, x].reshape(-1, 3)


def figures(content: bytes | None, read: Callable[[bytes], Image] = read_image, most_bytes: int = 10 * 1024 * 1024) -> dict:
    """All that is known of one file; ``error`` says what went wrong, if anything did."""
    out: dict = {"file_size": len(content or b""), "image_hash": hashlib.sha256(content or b"").hexdigest(), "has_transparency": False, "dominant_colors": [], "exif_data": {}}
    try:
        if not content or len(content) > most_bytes:
            raise ValueError("no content" if not content else f"over {most_bytes} bytes")
        out["exif_data"] = exif(content)
        im = read(content)
        height, width = im.rgb.shape[:2]
        out |= {"width": width, "height": height, "format": im.format, "color_mode": im.mode, "aspect_ratio": round(width / height, 2) if height else 0.0, "has_transparency": has_transparency(im.mode, im.alpha)}
        out["dominant_colors"] = [{"r": r, "g": g, "b": b, "percentage": share} for (r, g, b), share in dominant_colours(thumbnail(im.rgb))]
    except Exception as e:
        out["error"] = str(e)
    return out


FIGURES = pa.schema(
    [("width", pa.int32()), ("height", pa.int32()), ("format", pa.string()), ("file_size", pa.int64()), ("color_mode", pa.string()), ("has_transparency", pa.bool_()), ("aspect_ratio", pa.float64())]
    + [("image_hash", pa.string()), ("exif_data", pa.map_(pa.string(), pa.string())), ("dominant_colors", pa.list_(pa.struct([("r", pa.int32()), ("g", pa.int32()), ("b", pa.int32()), ("percentage", pa.float64())]))), ("error", pa.string())]
)
DDL = "width int, height int, format string, file_size long, color_mode string, has_transparency boolean, aspect_ratio double, image_hash string, exif_data map<string,string>, dominant_colors array<struct<r:int,g:int,b:int,percentage:double>>, error string"


def analysed(files: DataFrame, key: str = "path", content: str = "content", read: Callable[[bytes], Image] = read_image, most_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """(key, figures): one row per file. A null or broken file gives nulls and an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [figures(c, read, most_bytes) for c in b.column(1).to_pylist()]
            columns = [pa.array([list(r["exif_data"].items()) for r in rows] if f.name == "exif_data" else [r.get(f.name) for r in rows], f.type) for f in FIGURES]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[key, *FIGURES.names])

    rows = files.select(key, content)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {DDL}")


def of_store(store: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """An analyser of media (expression_id, url) from a table of files (url, content), with the colours on the web-safe palette."""

    def analyse(media: DataFrame) -> DataFrame:
        found = analysed(store.select("url", "content").dropDuplicates(["url"]).join(media.select("url").distinct(), "url", "left_semi"), "url").withColumnRenamed("error", "analysis_error")
        colours = found.select(F.col("url").alias("media_id"), F.explode("dominant_colors").alias("c")).select("media_id", "c.*")
        safe = palette_shares(colours).groupBy("media_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("colour", F.col("percentage").cast("string"))))).alias("websafe_colors"))
        return media.join(found.drop("dominant_colors"), "url").join(safe, F.col("url") == F.col("media_id"), "left").drop("media_id")

    return analyse
