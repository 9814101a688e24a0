"""Numeric kernels on pixels: DCT, perceptual hash, smart crop, thumbnails. All on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, KEPT = 256, 16
#: Pictures that are hashed in one product, with half a megabyte each meanwhile.
AT_ONCE = 64


def dct_matrix(n: int, kept: int) -> np.ndarray:
    """Unnormalised DCT-II: out[k] = sum of v[x] * cos(pi * k * (2x + 1) / 2n)."""
    return np.cos(np.pi * np.arange(kept)[:, None] * (2 * np.arange(n)[None] + 1) / (2 * n))


def dct(values: Column, n: int, kept: int) -> Column:
    """The DCT of an array of n numbers, as an expression."""
    rows = [F.array(*[F.lit(float(c)) for c in row]) for row in dct_matrix(n, kept)]
    return F.array(*[F.aggregate(F.zip_with(values, row, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for row in rows])


def median(values: Column) -> Column:
    """The mean of the two middle values of an array of even length, the middle one of an odd length."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.element_at(s, i.cast("int"))
    return (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2


@lru_cache(64)
def resize_weights(n: int, size: int) -> np.ndarray:
    """What each of n pixels gives to each of `size`: a triangle as wide as the scale, so that shrinking averages."""
    scale = n / size
    reach = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale - 0.5
    weight = np.maximum(0, 1 - np.abs(np.arange(n)[None] - centre[:, None]) / reach)
    return weight / weight.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize of a picture (height, width, and maybe colours)."""
    for axis, size in ((0, height), (1, width)):
        pixels = np.moveaxis(np.tensordot(resize_weights(pixels.shape[axis], size), pixels, axes=(1, axis)), 0, axis)
    return pixels


def resized_all(pictures: np.ndarray, width: int, height: int) -> np.ndarray:
    """The same for pictures of one size (picture, height, width) in one product for each side."""
    return resize_weights(pictures.shape[1], height) @ pictures @ resize_weights(pictures.shape[2], width).T


def luma(rgb: np.ndarray) -> np.ndarray:
    return np.round(rgb @ np.array([0.2126, 0.7152, 0.0722]))


def phashes(gray: np.ndarray) -> np.ndarray:
    """256 bits of each of some pictures of one size, as four words: which of the 16 x 16 lowest DCT coefficients of the picture at 256 x 256 exceed their median, highest bit first."""
    basis = dct_matrix(SIDE, KEPT)
    out = []
    for at in range(0, len(gray), AT_ONCE):
        small = np.clip(np.round(resized_all(gray[at : at + AT_ONCE].astype(float), SIDE, SIDE)), 0, 255)
        c = (basis @ small @ basis.T).reshape(len(small), -1)
        out.append(np.packbits(c > np.median(c, axis=1, keepdims=True), axis=1).view(">u8").astype(np.uint64).view(np.int64))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def phash(gray: np.ndarray) -> list[int]:
    """The four words of one picture."""
    return phashes(gray[None])[0].tolist()


def gradient_energy(gray: np.ndarray, step: int = 2) -> np.ndarray:
    """Squared Sobel gradients of every `step`-th pixel in both directions, from the first one on; beyond the edge the edge goes on."""
    around = [(0, 0)] * (gray.ndim - 2) + [(1, 1)] * 2
    g = np.pad(gray.astype(np.int64), around, mode="edge")
    gx = (g[..., :-2, 2:] + 2 * g[..., 1:-1, 2:] + g[..., 2:, 2:]) - (g[..., :-2, :-2] + 2 * g[..., 1:-1, :-2] + g[..., 2:, :-2])
    gy = (g[..., 2:, :-2] + 2 * g[..., 2:, 1:-1] + g[..., 2:, 2:]) - (g[..., :-2, :-2] + 2 * g[..., :-2, 1:-1] + g[..., :-2, 2:])
    mask = np.zeros(gray.shape[-2:], bool)
    mask[::step, ::step] = True
    return np.where(mask, gx * gx + gy * gy, 0)


def best_crops(energy: np.ndarray, width: int, height: int, step: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Left and top of the crop with the most energy of each picture (picture, height, width): the first one in rows of positions; the centre for a flat picture."""
    m, h, w = energy.shape
    width, height = min(width, w), min(height, h)
    table = np.zeros((m, h + 1, w + 1), np.int64)
    table[:, 1:, 1:] = energy.cumsum(1).cumsum(2)
    ys, xs = np.arange(0, h - height + 1, step), np.arange(0, w - width + 1, step)
    at = lambda y, x: table[:, y][:, :, x]
    sums = (at(ys + height, xs + width) - at(ys, xs + width) - at(ys + height, xs) + at(ys, xs)).reshape(m, -1)
    y, x = np.unravel_index(sums.argmax(1), (len(ys), len(xs)))
    flat = ~sums.any(1)
    return np.where(flat, (w - width) // 2, xs[x]), np.where(flat, (h - height) // 2, ys[y])


def best_crop(gray: np.ndarray, width: int, height: int, step: int = 2) -> tuple[int, int]:
    """The same for one picture."""
    x, y = best_crops(gradient_energy(gray, step)[None], width, height, step)
    return int(x[0]), int(y[0])


def smart_crop(gray: np.ndarray, width: int, height: int, longest: int = 256) -> tuple[int, int, int, int]:
    """Left, top, width and height of the best part of a picture with the ratio of width to height; all of a picture that isn't larger.

    The part is searched on a copy of at most `longest` pixels a side.
    """
    h, w = gray.shape
    if w <= width and h <= height:
        return 0, 0, w, h
    ratio = min(w / width, h / height)
    crop_w, crop_h = (min(w, h),) * 2 if width == height else (int(width * ratio), int(height * ratio))
    scale = min(1.0, longest / max(w, h))
    near = lambda x: int(np.floor(x + 0.5))
    small_w, small_h = max(1, near(w * scale)), max(1, near(h * scale))
    small = np.round(resized(gray.astype(float), small_w, small_h)) if scale < 1 else gray
    x, y = best_crop(small, min(max(1, near(crop_w * scale)), small_w), min(max(1, near(crop_h * scale)), small_h))
    return min(near(x / scale), w - crop_w), min(near(y / scale), h - crop_h), crop_w, crop_h


def thumbnail(rgb: np.ndarray, side: int = 150) -> np.ndarray:
    """The best square part at side x side."""
    x, y, w, h = smart_crop(luma(rgb), side, side)
    return np.clip(np.round(resized(rgb[y : y + h, x : x + w].astype(float), side, side)), 0, 255).astype(np.uint8)


def pixels_of(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """RGB of a row of Spark's image source, which stores BGR(A) or gray."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


FACTS = T.StructType([T.StructField("words", T.ArrayType(T.LongType())), *[T.StructField(c, T.IntegerType()) for c in ("crop_x", "crop_y", "width", "height")]])


def by_size(shapes: Iterable[tuple]) -> dict[tuple, list[int]]:
    """The places of pictures of each size."""
    out: dict[tuple, list[int]] = {}
    for i, shape in enumerate(shapes):
        out.setdefault(shape, []).append(i)
    return out


@F.pandas_udf(FACTS)
def picture_facts(images: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All that an import needs to know of a picture (image column of Spark's image source), from one decode; pictures of one size are hashed together."""
    for batch in images:
        grays = [luma(pixels_of(*x)) for x in zip(batch["data"], batch["width"], batch["height"], batch["nChannels"], strict=True)]
        rows: list = [None] * len(grays)
        for (h, w), which in by_size(g.shape for g in grays).items():
            for i, words in zip(which, phashes(np.stack([grays[i] for i in which])).tolist(), strict=True):
                x, y, _, _ = smart_crop(grays[i], 150, 150)
                rows[i] = (words, x, y, w, h)
        yield pd.DataFrame(rows, columns=["words", "crop_x", "crop_y", "width", "height"])


def flat_pictures(values: pa.Array) -> Iterator[tuple[list[int], np.ndarray]]:
    """The places of the pictures of each size in a column of square ones given as flat arrays, and these as (picture, side, side)."""
    flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(n or 0 for n in pc.list_value_length(values).to_pylist())])
    for (n,), which in by_size((int(b - a),) for a, b in zip(ends, ends[1:], strict=False)).items():
        side = int(n**0.5)
        if n and side * side == n:
            yield which, flat[ends[which][:, None] + np.arange(n)].reshape(len(which), side, side)


def in_place(found: list[tuple[list[int], list]], n: int, kind: pa.DataType) -> pa.Array:
    """Results by place; null where there's none."""
    rows: list = [None] * n
    for which, values in found:
        for i, x in zip(which, values, strict=True):
            rows[i] = x
    return pa.array(rows, kind)


@F.arrow_udf(T.ArrayType(T.LongType()))
def phash_of_gray(values: pa.Array) -> pa.Array:
    """Hash words of square gray pictures given as flat arrays; null for what isn't square."""
    return in_place([(which, phashes(g).tolist()) for which, g in flat_pictures(values)], len(values), pa.list_(pa.int64()))


CROP = T.StructType([T.StructField("energy", T.LongType()), T.StructField("crop_x", T.IntegerType()), T.StructField("crop_y", T.IntegerType())])


def crop_of_gray(side: int) -> Callable[[Column], Column]:
    """A function of square gray pictures as flat arrays: their gradient energy, and where their best part of side x side is."""

    @F.arrow_udf(CROP)
    def crop(values: pa.Array) -> pa.Array:
        found = []
        for which, gray in flat_pictures(values):
            energy = gradient_energy(gray)
            x, y = best_crops(energy, side, side)
            found.append((which, [{"energy": e, "crop_x": a, "crop_y": b} for e, a, b in zip(energy.sum((1, 2)).tolist(), x.tolist(), y.tolist(), strict=True)]))
        return in_place(found, len(values), pa.struct([("energy", pa.int64()), ("crop_x", pa.int32()), ("crop_y", pa.int32())]))

    return crop


def thumbnail_of_gray(width: int, height: int, side: int) -> Callable[[Column], Column]:
    """A function of gray pictures of one size as flat arrays: their best square part at side x side, as a flat array; null for other sizes."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def thumbnails(values: pa.Array) -> pa.Array:
        whole = pc.fill_null(pc.equal(pc.list_value_length(values), width * height), False)
        which = np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()
        gray = values.filter(whole).flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width)
        rows = []
        if len(gray):
            crop = min(width, height)
            x, y = best_crops(gradient_energy(gray), crop, crop) if max(width, height) > side else (np.zeros(len(gray), int),) * 2
            parts = np.stack([g[b : b + crop, a : a + crop] for g, a, b in zip(gray, x.tolist(), y.tolist(), strict=True)])
            rows = np.clip(np.round(resized_all(parts.astype(float), side, side)), 0, 255).astype(np.int64).reshape(len(gray), -1).tolist()
        return in_place([(which, rows)], len(values), pa.list_(pa.int32()))

    return thumbnails


# Weights of red, green and blue in 256ths and what is added, of brightness and the two colours, in full range and in limited range.
YUV = {
    True: ((77, 150, 29, 0), (-43, -85, 128, 128), (128, -107, -21, 128)),
    False: ((66, 129, 25, 16), (-38, -74, 112, 128), (112, -94, -18, 128)),
}


def yuv_planes(rgb: np.ndarray, full: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brightness of each pixel and the two colours of each 2 x 2 pixels (their mean, cut to whole numbers) of pictures (picture, height, width, 3). A last odd row or column has no colour."""
    m, h, w, _ = rgb.shape
    rgb = rgb.astype(np.int64)
    mean = rgb[:, : h // 2 * 2, : w // 2 * 2].reshape(m, h // 2, 2, w // 2, 2, 3).sum((2, 4)) // 4
    return tuple(np.clip(add + ((part @ np.array(weights) + 128) >> 8), 0, 255) for part, (*weights, add) in zip((rgb, mean, mean), YUV[full], strict=True))


def yuv420(width: int, height: int, full: bool = True) -> Callable[[Column], Column]:
    """A function of pictures of one size as flat arrays (red, green, blue of each pixel): their planes y, u and v as flat arrays; null for other sizes."""
    kind = T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in "yuv"])

    @F.arrow_udf(kind)
    def planes(values: pa.Array) -> pa.Array:
        whole = pc.fill_null(pc.equal(pc.list_value_length(values), width * height * 3), False)
        flat = values.filter(whole).flatten().to_numpy(zero_copy_only=False)
        parts = []
        for plane in yuv_planes(flat.reshape(-1, height, width, 3), full):
            size = plane.shape[1] * plane.shape[2]
            parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(plane) + 1) * size, pa.int32()), pa.array(plane.ravel(), pa.int32())))
        found = whole.to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays(parts, names=list("yuv")).take(pa.array(np.cumsum(found) - 1, pa.int64(), mask=~found))

    return planes
