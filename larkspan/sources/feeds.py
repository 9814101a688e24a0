"""External feed pages and queue records: landed JSON in, rows out; and a reader for paged HTTP feeds."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from larkspan.schemas import FEED_PAGE, QUEUE_ITEM, QUEUE_STATUS

ITEM = "id bigint, promoted bigint, image string, thumb string, fullsize string, audio boolean, mark int, `user` string"


def landed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of feed pages that lie as JSON files."""
    return spark.read.schema(FEED_PAGE).json(path, multiLine=True).select(F.explode("items").alias("item")).select("item.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, image string").json(path, multiLine=True)


def queue_items(text: DataFrame, column: str = "value") -> DataFrame:
    """Queue records from JSON text; what doesn't parse is dropped, a missing key is ''."""
    parsed = text.select(F.from_json(column, QUEUE_ITEM).alias("item")).where("item.post_id IS NOT NULL AND item.filename IS NOT NULL")
    return parsed.select("item.*").withColumn("job_key", F.coalesce("job_key", F.lit("")))


def queue_snapshot(status: DataFrame, posts: DataFrame, now: str, ttl_seconds: int = 60) -> DataFrame:
    """The latest status (ts, value) that is still fresh; without one the number of unfinished posts, not running, no ETA."""
    fresh = status.where(F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    last = fresh.agg(F.max_by("value", "ts").alias("value")).select(F.from_json("value", QUEUE_STATUS).alias("s")).select("s.*")
    waiting = posts.where("dirty AND NOT deleted").agg(F.count(F.lit(1)).cast("int").alias("n"))
    both = last.crossJoin(waiting)  # one row each
    first = lambda c, other: F.coalesce(F.col(c), other).alias(c)
    rate = F.coalesce("rate_per_sec", F.lit(0.0))
    eta = F.when(rate > 0, F.ceil(F.coalesce("pending", "n") / rate)).otherwise(-1).cast("int")
    return both.select(first("pending", F.col("n")), first("total", F.col("n")), first("processed", F.lit(0)), first("imported", F.lit(0)), first("failed", F.lit(0)), first("running", F.lit(False)), rate.alias("rate_per_sec"), eta.alias("eta_sec"))


def sse_events(text: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Records of server-sent events: frames end with an empty line, `data:` lines hold JSON; an unfinished last frame is left out."""
    frames = F.split(column, "\n\n")
    whole = text.select(F.explode(F.slice(frames, F.lit(1), F.size(frames) - 1)).alias("frame"))
    return whole.where(F.col("frame").startswith("data:")).select(F.from_json(F.trim(F.substring("frame", 6, 1 << 30)), schema).alias("e")).where("e IS NOT NULL").select("e.*")


def sse_frame(row: Column) -> Column:
    """A frame with a struct as JSON, which has no line break in it."""
    return F.concat(F.lit("data: "), F.to_json(row), F.lit("\n\n"))


def sse_frames(rows: DataFrame) -> DataFrame:
    return rows.select(sse_frame(F.struct("*")).alias("value"))


def directory_usage(spark: SparkSession, folders: dict[str, str], excluded: list[str] | None = None) -> DataFrame:
    """Bytes and files below each labelled folder, without the excluded subfolders. Contents aren't read."""
    out = None
    for label, path in folders.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
        for sub in excluded or []:
            files = files.where(~F.contains("path", F.lit(f"/{sub}/")))
        part = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files")).select(F.lit(label).alias("label"), "bytes", "files")
        out = part if out is None else out.unionByName(part)
    return out


def disk_usage(files: DataFrame) -> DataFrame:
    """Bytes and files by label of a listing (label, length)."""
    return files.groupBy("label").agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("files"))


def wait_after(status: int, headers: dict, attempt: int, now: float | None = None) -> float:
    """Seconds to wait after a refusal: Retry-After as seconds or as a date, else 2, 4, 8, ... up to 60."""
    from email.utils import parsedate_to_datetime

    asked = headers.get("Retry-After")
    if asked:
        try:
            return max(0.0, float(asked))
        except ValueError:
            try:
                return max(0.0, parsedate_to_datetime(asked).timestamp() - (time.time() if now is None else now))
            except (TypeError, ValueError):
                pass
    return min(2.0 ** (attempt + 1), 60.0)


def fetch_page(base: str, params: dict, retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One page; tries again after 429 and 503."""
    url = f"{base}?{urllib.parse.urlencode({k: v for k, v in params.items() if v not in (None, '')})}"
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:  # noqa: S310  the caller names the address
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in (429, 503) or attempt == retries:
                raise
            sleep(wait_after(e.code, dict(e.headers), attempt))
    raise AssertionError


def cursor_of(items: list[dict], key: str) -> int:
    """The smallest key of a page; 0 for an empty one."""
    return min((int(i.get(key) or 0) for i in items), default=0)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # each page's address is in the page before it

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o, cursor = self.options, int(self.options.get("older", "0"))
        key = o.get("cursor", "promoted")
        pages, taken = int(o["pages"]) if "pages" in o else None, 0
        while pages is None or taken < pages:
            taken += 1
            page = fetch_page(o["url"], {"tags": o.get("tags"), "flags": o.get("flags"), "older": cursor or None})
            items = page.get("items") or []
            for i in items:
                yield tuple(i.get(c) for c in ("id", "promoted", "image", "thumb", "fullsize", "audio", "mark", "user"))
            cursor = cursor_of(items, key)
            if page.get("atEnd") or not items or not cursor:
                return


class Span(InputPartition):
    """Items below `older` (0: from the newest on) down to `until`, none above `top`."""

    def __init__(self, older: int, until: int, top: int) -> None:
        self.older, self.until, self.top = older, until, top


class FeedStreamReader(DataSourceStreamReader):
    """Walks a feed from its newest items back, some pages a batch. The offset is the cursor: {older, top, pages, ended}.

    `top` is the newest key when the stream began: what comes later isn't in it. A batch's offset says down to which key it goes, so a batch
    that runs again gives the same items though the feed has grown and its pages have shifted; and a restart goes on where the last batch ended.
    """

    def __init__(self, options: dict) -> None:
        self.options, self.key = options, options.get("cursor", "promoted")
        self.pages = int(options.get("pages", "10"))
        self.at: dict | None = None
        self.spans: dict[int, Span] = {}  # of pages that latestOffset has seen, by the cursor before them

    def _page(self, older: int) -> dict:
        o = self.options
        return fetch_page(o["url"], {"tags": o.get("tags"), "flags": o.get("flags"), "older": older or None})

    def initialOffset(self) -> dict:  # noqa: N802  the interface's names
        return {"older": int(self.options.get("older", "0")), "top": 0, "pages": 0, "ended": False}

    def latestOffset(self) -> dict:  # noqa: N802
        at = dict(self.at or self.initialOffset())
        self.spans = {}
        for _ in range(self.pages):
            if at["ended"]:
                break
            page = self._page(at["older"])
            items = page.get("items") or []
            cursor = cursor_of(items, self.key)
            if items and not at["top"]:
                at["top"] = max(int(i.get(self.key) or 0) for i in items)
            if items:
                self.spans[at["older"]] = Span(at["older"], cursor, at["top"])
            at = {"older": cursor or at["older"], "top": at["top"], "pages": at["pages"] + bool(items), "ended": bool(page.get("atEnd") or not items or not cursor)}
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A page each as far as they are known; after a restart the whole stretch is one, to be walked again."""
        if start["pages"] == end["pages"]:
            self.at = dict(end)  # a restart tells where it goes on
            return []
        found, older = [], start["older"]
        while older in self.spans and (not found or older != end["older"]):
            found.append(self.spans[older])
            older = found[-1].until
        if older == end["older"] and found:
            return found
        self.at = self.at or dict(end)
        return [Span(start["older"], end["older"], end["top"])]

    def read(self, partition: Span) -> Iterator[tuple]:
        older = partition.older
        while True:
            page = self._page(older)
            items = page.get("items") or []
            for i in items:
                if partition.until <= int(i.get(self.key) or 0) <= partition.top:
                    yield tuple(i.get(c) for c in ("id", "promoted", "image", "thumb", "fullsize", "audio", "mark", "user"))
            older = cursor_of(items, self.key)
            if not items or older <= partition.until or page.get("atEnd"):
                return

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """spark.read.format("paged_feed").option("url", ...): items of a feed; options tags, flags, older, cursor (promoted or id), and pages (without it, to the end).

    spark.readStream does the same as a stream; pages are then those of a batch (10 without the option).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return FeedStreamReader(self.options)


def status_row(pending: Column, total: Column, processed: Column, imported: Column, failed: Column, running: Column, rate: Column, eta: Column) -> Column:
    """A status record of the queue as JSON, to be appended with its time and read while fresh (`queue_snapshot`)."""
    names = [x.split()[0] for x in QUEUE_STATUS.split(", ")]
    return F.to_json(F.struct(*[c.alias(n) for n, c in zip(names, (pending, total, processed, imported, failed, running, rate, eta), strict=True)]))


def duplicates_row(post: Column, others: Column) -> Column:
    """A record of the posts that look like one, as JSON, to be appended with its time and kept for jobs.DUPLICATES_TTL seconds."""
    return F.to_json(F.struct(post.alias("post_id"), others.alias("duplicates")))
