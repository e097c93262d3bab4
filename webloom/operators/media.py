"""Media: image figures, dominant colours and the web-safe palette."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: step of the 216 web-safe colours.
STEP = 51


def web_safe(r: Column, g: Column, b: Column) -> Column:
    """Nearest web-safe colour as #rrggbb (channel steps of 51 are odd, so there are no ties)."""
    part = lambda c: F.lpad(F.lower(F.hex((F.round(c / STEP) * STEP).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def rgb_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Squared distance of two colours."""
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0))


def palette_shares(colours: DataFrame) -> DataFrame:
    """(media_id, colour, percentage): shares of the web-safe colours; input media_id, r, g, b, percentage."""
    return colours.groupBy("media_id", web_safe(F.col("r"), F.col("g"), F.col("b")).alias("colour")).agg(F.round(F.sum("percentage"), 2).alias("percentage"))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(F.coalesce(height, F.lit(0)) == 0, 0.0).otherwise(F.round(width / height, 2))


def dominant_colours(pixels: np.ndarray, k: int = 5, seed: int = 42, rounds: int = 20) -> list[tuple[tuple[int, int, int], float]]:
    """Colours of k clusters of (n, 3) pixels with their share in per cent, largest first: Lloyd's algorithm from seeded, spread starting points."""
    p = np.asarray(pixels, float).reshape(-1, 3)
    r = np.random.default_rng(seed)
    centres = p[r.integers(len(p))][None]
    while len(centres) < min(k, len(np.unique(p, axis=0))):
        d = ((p[:, None] - centres) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, p[r.choice(len(p), p=d / d.sum())]])
    for _ in range(rounds):
        near = ((p[:, None] - centres) ** 2).sum(-1).argmin(1)
        moved = np.array([p[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(moved, centres):
            break
        centres = moved
    n = np.bincount(near, minlength=len(centres))
    out = [(tuple(int(x) for x in c), round(100 * m / len(p), 2)) for c, m in zip(centres, n, strict=True)]
    return sorted(out, key=lambda x: (-x[1], x[0]))


def has_transparency(mode: str, alpha: np.ndarray | None) -> bool:
    """Whether an image with an alpha channel has a pixel that is not opaque."""
    return mode in ("RGBA", "LA") and alpha is not None and bool((np.asarray(alpha) < 255).any())


def without_media(media: DataFrame, expressions: DataFrame, kind: str | None = None) -> DataFrame:
    """Media that are left when those of the pages (column id), of a type if given, are deleted."""
    gone = expressions.select(F.col("id").alias("expression_id"))
    if kind is None:
        return media.join(gone, "expression_id", "left_anti")
    return media.join(gone.withColumn("type", F.lit(kind)), ["expression_id", "type"], "left_anti")


def stored_markup(binary_files: DataFrame) -> DataFrame:
    """Content hash and size of files read with the binaryFile source."""
    return binary_files.select("path", F.sha2("content", 256).alias("image_hash"), F.col("length").alias("file_size"))
