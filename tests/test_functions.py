import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import kernels, labels, text
from larkspan.operators import search


@pytest.mark.parametrize(
    ("requested", "level", "want"),
    [("", 0, ["sfw"]), ("", 1, ["sfw", "nsfp", "nsfw"]), ("secret,sfw", 1, ["sfw"]), ("secret,sfw", 5, ["secret", "sfw"]), (" nsfp , nsfp", 10, ["nsfp"]), ("bogus", 10, [])],
)
def test_allowed_filters(spark, requested, level, want):
    assert labels.allowed_filters(requested, level) == want
    row = spark.range(1).select(labels.allowed_filters_column(F.lit(requested), F.lit(level)).alias("x")).first()
    assert row.x == want


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.file_type(lit("a/b.C.JPG")), text.file_type(lit("x.mov")), text.file_type(lit("x.tar")), text.file_type(lit("none"))) == ["image/jpeg", "video/quicktime", "unknown/tar", "unknown/"]
    assert one(spark, text.importable(lit("a.JPG")), text.importable(lit("a.png")), text.importable(lit(""))) == [True, False, False]
    assert one(spark, text.format_bytes(lit(0)), text.format_bytes(lit(1536)), text.format_bytes(lit(3 * 1024**3))) == ["0 B", "1.5 KB", "3.0 GB"]
    assert one(spark, text.format_duration(lit(59)), text.format_duration(lit(61)), text.format_duration(lit(7260))) == ["59s", "1m 1s", "2h 1m"]
    assert one(spark, text.snippet(lit("a" * 121)), text.snippet(lit("a" * 120)), text.snippet(lit("ä" * 70)), text.snippet(lit("ä" * 60)), text.snippet(lit("a" + "ä" * 60))) == ["a" * 120 + "…", "a" * 120, "ä" * 60 + "…", "ä" * 60, "a" + "ä" * 59 + "…"]
    assert one(spark, text.snippet(lit("x" * 119 + "𝄞𝄞")), text.snippet(lit("x" * 118 + "€€"))) == ["x" * 119 + "…", "x" * 118 + "…"]
    ago = lambda n: text.time_ago(F.expr("timestamp_ntz'2024-01-01'"), F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, {n})"))
    assert one(spark, *[ago(n) for n in (59, 60, 179, 3600, 7200, 86400, 30 * 86400, 359 * 86400, 360 * 86400, 800 * 86400)]) == ["just now", "1 min ago", "2 min ago", "1 hour ago", "2 hours ago", "1 day ago", "1 month ago", "11 months ago", "1 year ago", "2 years ago"]
    assert one(spark, text.retry_delay(lit(0), lit(None).cast("int")), text.retry_delay(lit(9), lit(None).cast("int")), text.retry_delay(lit(2), lit(7))) == [2.0, 60.0, 7.0]
    assert one(spark, text.page_number(lit("x"), 1), text.page_number(lit("0"), 1), text.page_number(lit("7"), 1)) == [1, 1, 7]
    assert one(spark, text.valid_email(lit("a@b.de")), text.valid_email(lit("a b@c")), text.valid_name(lit("abc")), text.valid_name(lit("äb1"))) == [True, False, False, True]
    assert one(spark, text.dimensions(lit("640,480")), text.dimensions(lit("x"))) == [(640, 480), (0, 0)]
    assert one(spark, text.scaled(lit(1921), lit(1081), lit(920)), text.scaled(lit(101), lit(51), lit(920))) == [(920, 518), (100, 50)]
    assert one(spark, text.scaled(lit(0), lit(9), lit(920)), text.scaled(lit(9), lit(0), lit(920)), text.scaled(lit(1921), lit(1081), lit(0)), text.scaled(lit(300), lit(200), lit(101))) == [(0, 0), (0, 0), (1920, 1080), (100, 66)]
    assert one(spark, text.search_user(lit("cat User:bob dog")), text.search_tags(lit("cat User:bob dog")), text.search_tags(lit("user:x"))) == ["bob", ["cat", "dog"], []]
    assert one(spark, text.toggled(lit(1), lit(1)), text.toggled(lit(1), lit(-1)), text.indent(lit(12)), text.grid_columns(lit(100)), text.grid_columns(lit(500))) == [0, -1, 128, 2, 3]
    assert one(spark, text.progress_percent(lit(1), lit(3), lit(True)), text.progress_percent(lit(0), lit(0), lit(True)), text.progress_percent(lit(0), lit(0), lit(False))) == [33, 0, 100]
    shown = lambda x: text.redacted(lit(x))
    assert one(spark, shown('{"password":"a\\"b","x":{"token": 5,"y":1}}'), shown('{"password":[1,2],"b":2}'), shown('{"list":[{"secret":{"a":1}}],"secret":{"a":"}"}}'), shown("[1]"), shown("a=b"), shown("")) == ['{"password":"[REDACTED]","x":{"token":"[REDACTED]","y":1}}', '{"b":2,"password":"[REDACTED]"}', '{"list":[{"secret":{"a":1}}],"secret":"[REDACTED]"}', "[non-JSON body]", "[non-JSON body]", None]
    assert one(spark, shown('{"a":"' + "x" * 2041 + '"}'), shown('{"a":"' + "ä" * 1020 + '"}'), shown('{"a":' * 400 + "1" + "}" * 400)) == ["[body too large to log]", '{"a":"' + "ä" * 1020 + '"}', "[body too large to log]"]
    assert one(spark, text.media_url(lit("https://a.b/c.webm?x=1")), text.media_url(lit("https://a.b/c")), text.search_terms(lit("a%20b c"))) == [True, False, ["a", "b c"]]


def test_parse_search():
    assert search.parse_search("cat USER:bob dog user:eve") == ("bob", ["cat", "dog"])
    assert search.parse_search("") == (None, []) and search.parse_path("a%20b") == ["a", "b"]


def test_dct_and_median(spark):
    v = np.arange(1.0, 9.0)
    assert np.isclose((kernels.dct_matrix(8, 4) @ v)[0], 36) and not (kernels.dct_matrix(8, 4) @ np.zeros(8)).any()
    assert np.abs((kernels.dct_matrix(256, 16) @ np.ones(256))[1:]).max() < 1e-6
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    assert np.allclose(df.select(kernels.dct(F.col("v"), 8, 4)).first()[0], kernels.dct_matrix(8, 4) @ v)
    med = lambda x: spark.createDataFrame([(x,)], "v array<double>").select(kernels.median(F.col("v"))).first()[0]
    assert med([float(i) for i in range(256)]) == 127.5 and med([42.0] * 256) == 42 and med([0.0] * 128 + [1.0] * 128) == 0.5 and med([3.0, 1.0, 2.0]) == 2


def bits(a, b):
    return sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(a, b, strict=True))


def test_phash_and_crop(spark):
    y, x = np.mgrid[0:256, 0:256]
    picture = ((x * 3 + y * 5 + (x * y) // 97) % 200).astype(float)
    a = kernels.phash(picture)
    assert len(a) == 4 and kernels.phash(picture) == a and bits(a, kernels.phash(picture + 2)) < 64
    other = ((x // 32 + y // 16) % 2 * 200).astype(float)
    assert bits(a, kernels.phash(other)) > 50
    assert kernels.phash(np.kron(picture, np.ones((2, 2)))) and kernels.gradient_energy(np.full((20, 20), 7)).sum() == 0
    busy = np.zeros((100, 300))
    busy[:, 200:] = np.random.default_rng(0).integers(0, 255, (100, 100))
    left, top = kernels.best_crop(busy, 100, 100)
    assert left >= 196 and top == 0 and kernels.best_crop(np.zeros((100, 300)), 100, 100) == (100, 0)
    assert kernels.thumbnail(np.repeat(busy[:, :, None], 3, axis=2)).shape == (150, 150, 3)
    df = spark.createDataFrame([(picture.ravel().tolist(),)], "v array<double>")
    assert df.select(kernels.phash_of_gray("v")).first()[0] == a
