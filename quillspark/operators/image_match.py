"""Matching of perceptual hashes (256 bits, as four 64-bit integers) by bands, exact up to a distance of 15."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS, BAND_BITS = 16, 16


def bands(h: Column) -> Column:
    """The sixteen 16-bit bands of a hash (array of four longs)."""
    return F.array(*(F.pmod(F.shiftrightunsigned(h[i // 4], BAND_BITS * (i % 4)), F.lit(1 << BAND_BITS)).cast("int") for i in range(BANDS)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


KEY = ("h0", "h1", "h2", "h3")


def _keyed(images: DataFrame) -> DataFrame:
    return images.select("idx", "name", *(F.col("hash")[i].alias(h) for i, h in enumerate(KEY)))


def exact(images: DataFrame) -> DataFrame:
    """Pairs of images with the same hash. ``images``: ``idx, name, hash``."""
    side = lambda p: _keyed(images).select(F.col("idx").alias(f"i{p}"), F.col("name").alias(f"image_{p}"), *KEY)
    both = side("a").join(side("b"), list(KEY)).where("ia < ib")
    return both.select("image_a", "image_b", F.lit(0).cast("long").alias("distance"), F.lit(True).alias("exact"))


def _nodes(images: DataFrame) -> DataFrame:
    """``node, hash``: a node for each distinct hash, however many images have it."""
    return _keyed(images).groupBy(*KEY).agg(F.min("idx").alias("node")).select("node", F.array(*KEY).alias("hash"))


def _banded(nodes: DataFrame, p: str) -> DataFrame:
    return nodes.select(F.col("node").alias(p), F.posexplode(bands(F.col("hash"))).alias("band", "key"))


def _near(left: DataFrame, right: DataFrame, threshold: int, same: bool) -> DataFrame:
    """``a, b, distance`` of nodes that share a band; hashes come in after pairs are distinct."""
    both = _banded(left, "a").join(_banded(right, "b"), ["band", "key"])
    pairs = (both.where("a < b") if same else both).select("a", "b").distinct()
    hashes = lambda n, p: n.select(F.col("node").alias(p), F.col("hash").alias(f"h{p}"))
    told = pairs.join(hashes(left, "a"), "a").join(hashes(right, "b"), "b")
    return told.select("a", "b", hamming(F.col("ha"), F.col("hb")).cast("long").alias("distance")).where(F.col("distance") <= threshold)


def _members(images: DataFrame, nodes: DataFrame, p: str) -> DataFrame:
    of = nodes.select("node", *(F.col("hash")[i].alias(h) for i, h in enumerate(KEY)))
    return _keyed(images).join(of, list(KEY)).select(F.col("node").alias(p), F.col("idx").alias(f"i{p}"), F.col("name").alias(f"n{p}"))


def lsh_join(images: DataFrame, threshold: int) -> DataFrame:
    """Pairs within ``threshold`` bits; all of them up to 15, beyond that those that share a band. In no order."""
    nodes = _nodes(images)
    near = _near(nodes, nodes, threshold, True).join(_members(images, nodes, "a"), "a").join(_members(images, nodes, "b"), "b")
    first = F.col("ia") < F.col("ib")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return near.select(pick("na", "nb").alias("image_a"), pick("nb", "na").alias("image_b"), "distance", F.lit(False).alias("exact")).unionByName(exact(images))


def cross_join(source: DataFrame, dataset: DataFrame, threshold: int) -> DataFrame:
    """Matches of source images among a dataset's, in no order."""
    left, right = _nodes(source), _nodes(dataset)
    near = _near(left, right, threshold, False).join(_members(source, left, "a"), "a").join(_members(dataset, right, "b"), "b")
    return near.select(F.col("na").alias("source_image"), F.col("nb").alias("dataset_image"), "distance", (F.col("distance") == 0).alias("exact"))


def rows_or_notice(pairs: DataFrame) -> DataFrame:
    """The pairs, or a single row that says there are none."""
    if pairs.isEmpty():
        return pairs.sparkSession.createDataFrame([("No matches found",)], "result string")
    return pairs


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def _lanczos(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``n`` places its first pixel among ``size`` and its weights (three lobes, widened when shrinking), as 22-bit fractions."""
    scale = size / n
    wide = max(scale, 1.0)
    centre = (np.arange(n) + 0.5) * scale
    first = np.maximum(0, (centre - 3 * wide + 0.5).astype(np.int64))
    end = np.minimum(size, (centre + 3 * wide + 0.5).astype(np.int64))
    at = first[:, None] + np.arange((end - first).max())
    x = (at - centre[:, None] + 0.5) / wide
    w = np.where((np.abs(x) < 3) & (at < end[:, None]), np.sinc(x) * np.sinc(x / 3), 0.0)
    w /= w.sum(1, keepdims=True)
    return np.minimum(at, size - 1), np.where(w < 0, -np.floor(-w * (1 << 22) + 0.5), np.floor(w * (1 << 22) + 0.5)).astype(np.int64)


def _shrunk(grey: np.ndarray, n: int) -> np.ndarray:
    """Rows of pixels brought to ``n`` pixels each, rounded to bytes."""
    if grey.shape[1] == n:
        return grey
    at, w = _lanczos(grey.shape[1], n)
    return np.clip((np.einsum("rnk,nk->rn", grey[:, at].astype(np.int64), w) + (1 << 21)) >> 22, 0, 255)


def phash(grey: np.ndarray, size: int = 16, factor: int = 4) -> np.ndarray:
    """Signs of the low frequencies of a grey image (bytes, any size) against their median, as four 64-bit integers.

    The picture is brought to 64 x 64 by a Lanczos filter, across and then down, and its cosine transform's first
    16 x 16 terms make the bits, row by row: the usual perceptual hash, so that hashes compare with stored ones.
    """
    n = size * factor
    small = _shrunk(_shrunk(grey.astype(np.int64), n).T, n).T
    c = _cosines(n)
    low = (c @ small @ c.T)[:size, :size]
    return np.packbits((low > np.median(low)).ravel()).view(">i8").astype(np.int64)


def hash_images(images: DataFrame) -> DataFrame:
    """``name, hash`` of Spark's image source rows; what can't be decoded is left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            names, hashes = [], []
            for r in pdf.itertuples():
                if r.height <= 0 or r.width <= 0:
                    continue
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(np.int64)
                grey = a[..., 0] if r.nChannels == 1 else (a[..., :3] @ np.array([7471, 38470, 19595]) + 0x8000) >> 16  # blue, green, red
                names.append(r.origin)
                hashes.append(phash(grey).tolist())
            yield pd.DataFrame({"name": names, "hash": hashes})

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "name string, hash array<long>")
