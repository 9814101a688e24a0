import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larkspan.functions import kernels
from larkspan.plans import registry


def plain_resize(g, width, height):
    """Pixel by pixel, by the triangle's definition."""
    def line(values, size):
        scale = len(values) / size
        reach = max(scale, 1.0)
        out = []
        for i in range(size):
            centre = (i + 0.5) * scale - 0.5
            w = [max(0.0, 1 - abs(x - centre) / reach) for x in range(len(values))]
            out.append(sum(a * b for a, b in zip(w, values, strict=True)) / sum(w))
        return out

    rows = [line(r, width) for r in g]
    return list(zip(*[line([r[x] for r in rows], height) for x in range(width)], strict=True))


@pytest.fixture(scope="module")
def grays(data):
    table = pq.read_table(f"{data}/sf0.001/embeddings.parquet")
    return {i: [min(max(float(np.float32(x)) * 100 + 128, 0.0), 255.0) for x in e] for i, e in zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True)}


def test_picture_hashes_equal_plain_loops(spark, data, grays):
    got = {r.vec_id: [r.p_hash_0, r.p_hash_1, r.p_hash_2, r.p_hash_3] for r in registry.QUERIES["picture_hashes"](spark, f"{data}/sf0.001").collect()}
    assert got.keys() == grays.keys()
    cosines = [[math.cos(math.pi * k * (2 * x + 1) / 512) for x in range(256)] for k in range(16)]
    for i in sorted(grays)[:6]:
        g = [grays[i][8 * r : 8 * r + 8] for r in range(8)]
        small = [[float(np.clip(np.round(v), 0, 255)) for v in row] for row in plain_resize(g, 256, 256)]
        rows = [[sum(c * v for c, v in zip(cosines[k], row, strict=True)) for k in range(16)] for row in small]
        c = [sum(cosines[k][y] * rows[y][j] for y in range(256)) for k in range(16) for j in range(16)]
        middle = (sorted(c)[127] + sorted(c)[128]) / 2
        bits = [(w >> (63 - b)) & 1 for w in got[i] for b in range(64)]
        assert all(bit == (v > middle) for bit, v in zip(bits, c, strict=True) if abs(v - middle) > 1e-3)


def test_thumbnails_equal_plain_loops(spark, data, grays):
    got = {r.vec_id: [int(x) for x in r.pixels.split(",")] for r in registry.QUERIES["picture_thumbnails"](spark, f"{data}/sf0.001").collect()}
    assert got.keys() == grays.keys()
    for i, g in grays.items():
        want = [v for row in plain_resize([[math.floor(x) for x in g[8 * r : 8 * r + 8]] for r in range(8)], 3, 3) for v in row]
        assert all(abs(a - b) <= 0.5 + 1e-6 for a, b in zip(got[i], want, strict=True))


def test_picture_facts_equal_hashes_of_the_same_pixels(spark, data, grays):
    got = registry.QUERIES["picture_facts"](spark, f"{data}/sf0.001").collect()
    assert {r.vec_id for r in got} == grays.keys()
    for r in got:
        gray = np.round(np.floor(np.array(grays[r.vec_id])).reshape(8, 8))
        assert [r.p_hash_0, r.p_hash_1, r.p_hash_2, r.p_hash_3] == kernels.phash(kernels.luma(np.repeat(gray[:, :, None], 3, 2))) and (r.width, r.height, r.crop_x, r.crop_y) == (8, 8, 0, 0)


def test_batches_equal_single_pictures(spark):
    rng = np.random.default_rng(1)
    pictures = [rng.integers(0, 256, (s, s)) for s in (4, 9, 16, 9, 4, 16, 16)] + [np.full((9, 9), 7)]
    rows = [(i, p.ravel().tolist()) for i, p in enumerate(pictures)] + [(90, None), (91, []), (92, [1, 2, 3])]
    frame = spark.createDataFrame(rows, "id int, g array<int>").coalesce(1)
    got = {r.id: r for r in frame.select("id", kernels.phash_of_gray(F.col("g")).alias("w"), kernels.crop_of_gray(4)(F.col("g")).alias("c")).collect()}
    for i, p in enumerate(pictures):
        assert got[i].w == kernels.phash(p) and got[i].c[:] == (int(kernels.gradient_energy(p).sum()), *kernels.best_crop(p, 4, 4))
    assert all(got[i].w is None and got[i].c is None for i in (90, 91, 92))


def test_colours():
    solid = lambda *c: np.tile(np.array(c), (1, 2, 2, 1))
    planes = lambda c, full: [int(p.ravel()[0]) for p in kernels.yuv_planes(solid(*c), full)]
    assert planes((0, 0, 0), True) == [0, 128, 128] and planes((255, 255, 255), True) == [255, 128, 128] and planes((128, 128, 128), True) == [128, 128, 128]
    assert planes((0, 0, 0), False) == [16, 128, 128] and planes((255, 255, 255), False) == [235, 128, 128]
    assert planes((255, 0, 0), True)[2] == 255 and planes((0, 0, 255), True)[1] == 255
    y, u, v = kernels.yuv_planes(np.zeros((2, 5, 7, 3)), True)
    assert y.shape == (2, 5, 7) and u.shape == v.shape == (2, 2, 3)


def test_colours_of_other_sizes_are_null(spark):
    frame = spark.createDataFrame([(1, [255] * 12), (2, None), (3, [1])], "id int, p array<int>")
    got = {r.id: r.x for r in frame.select("id", kernels.yuv420(2, 2)(F.col("p")).alias("x")).collect()}
    assert got[1].y == [255] * 4 and got[1].u == [128] and got[2] is None and got[3] is None
