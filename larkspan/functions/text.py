"""Formatting and parsing of values, as columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def time_ago(then: Column, now: Column) -> Column:
    """Whole minutes, hours, days, months of 30 days or years of 12 such months; minutes are never in the plural. '' for null."""
    return seconds_ago(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp")))


def seconds_ago(s: Column) -> Column:
    """The same for a number of whole seconds, which may be more than timestamps and intervals hold."""

    def whole(seconds: int) -> Column:
        return F.call_function("div", s, F.lit(seconds))

    def unit(seconds: int, name: str) -> Column:
        n = whole(seconds)
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    minutes = F.concat(whole(60).cast("string"), F.lit(" min ago"))
    return F.when(s.isNull(), "").when(s < 60, "just now").when(s < 3600, minutes).when(s < 86400, unit(3600, "hour")).when(s < 2592000, unit(86400, "day")).when(s < 31104000, unit(2592000, "month")).otherwise(unit(31104000, "year"))


def format_bytes(n: Column) -> Column:
    """Base 1024, one decimal; nothing is "0 B"."""
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).when(n < 1024**4, 3).otherwise(4)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")]), step + 1)
    return F.when(n == 0, "0 B").otherwise(F.concat(F.format_string("%.1f", n / F.pow(F.lit(1024.0), step)), F.lit(" "), unit))


def format_duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(seconds < 60, F.format_string("%ds", s)).when(seconds < 3600, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%dh %dm", h, m))


def snippet(text: Column, n: int = 120, suffix: str = "…") -> Column:
    """A text of over n bytes of UTF-8: the whole characters within its first n bytes, and an ellipsis; a shorter one as it is."""
    raw = text.cast("binary")
    first = lambda k: F.substring(raw, 1, k).cast("string")
    goes_on = lambda k: F.hex(F.substring(raw, k + 1, 1)).between("80", "BF")  # noqa: E731  the byte after k is inside a character
    cut = F.when(~goes_on(n), first(n)).when(~goes_on(n - 1), first(n - 1)).when(~goes_on(n - 2), first(n - 2)).otherwise(first(n - 3))
    return F.when(F.octet_length(text) > n, F.concat(cut, F.lit(suffix))).otherwise(text)


def log_preview(text: Column, n: int) -> Column:
    """The same for log lines, which mark the cut by [\u2026]."""
    return snippet(text, n, "[…]")


def extension(name: Column) -> Column:
    """The extension with its dot, in lower case; '' if there's none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


# What an import takes, and the file types that processing knows.
IMPORTABLE = [".jxl", ".avif", ".webp", ".jpg", ".gif"]
IMAGES = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "gif": "gif", "webp": "webp", "avif": "avif", "jxl": "jxl", "bmp": "bmp", "tiff": "tiff", "tif": "tiff"}
VIDEOS = {"mp4": "mp4", "webm": "webm", "mov": "quicktime", "mkv": "x-matroska", "avi": "x-msvideo"}


def importable(name: Column) -> Column:
    return extension(name).isin(IMPORTABLE)


def file_type(name: Column) -> Column:
    """MIME type by extension; unknown/<extension> for others."""
    ext = F.substring(extension(name), 2, 100)
    out = F.concat(F.lit("unknown/"), ext)
    for kinds, major in ((VIDEOS, "video"), (IMAGES, "image")):
        for e, minor in kinds.items():
            out = F.when(ext == e, f"{major}/{minor}").otherwise(out)
    return out


# The patterns of video names, links to media, and (below) user names in a search box and email addresses.
def is_video(content_type: Column, name: Column) -> Column:
    return F.coalesce(content_type.startswith("video/"), F.lit(False)) | F.coalesce(name.rlike(r"(?i)\.(mp4|webm|mov)$"), F.lit(False))


def media_url(text: Column) -> Column:
    return text.rlike(r"(?i)^https?://.+\.(?:jpe?g|png|gif|webp|avif|bmp|tiff?|svg|mp4|webm|mov|avi|mkv)(\?.*)?$")


def thumbnail_url(thumbnail: Column, name: Column) -> Column:
    """Where a post's small picture is: the thumbnail's file, else the post's own; null without either."""
    file = F.coalesce(F.nullif(thumbnail, F.lit("")), F.nullif(name, F.lit("")))
    return F.concat(F.lit("/images/thumbnails/"), file)


def search_terms(query: Column) -> Column:
    """Tags of a search path, which stand between the three characters %20."""
    return F.split(query, "%20")


def search_user(text: Column) -> Column:
    """The name in a `user:name` token of a search box, null without one."""
    name = F.regexp_extract(text, r"(?i)(?:^|\s)user:(\S+)", 1)
    return F.when(name != "", name)


def search_tags(text: Column) -> Column:
    """What else a search box has, split at white space."""
    rest = F.trim(F.regexp_replace(text, r"(?i)(^|\s)user:\S+", " "))
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, r"\s+"))


def page_number(text: Column, default: int) -> Column:
    """A positive integer (digits, maybe a sign, nothing else), or the default."""
    n = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.when(n >= 1, n).otherwise(default).cast("bigint")


def valid_email(text: Column) -> Column:
    return F.octet_length(text).between(3, 254) & text.rlike(r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$")


def valid_name(text: Column) -> Column:
    return F.octet_length(text) >= 4


def dimensions(text: Column) -> Column:
    """width and height of a probe's `w,h`; 0 for what is no number, and for both without a comma."""
    parts = F.split(F.trim(text), ",")
    part = lambda i: F.when(F.size(parts) >= 2, F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0))).otherwise(0)
    return F.struct(part(1).alias("width"), part(2).alias("height"))


def scaled(width: Column, height: Column, most: Column) -> Column:
    """Even dimensions of the same ratio with at most `most` wide (0: any width); 0 and 0 if a side is unknown (0)."""
    even = lambda c: c.cast("int").bitwiseAND(F.lit(-2))
    as_is = (most == 0) | (width <= most)
    known = (width != 0) & (height != 0)
    high = F.round(height * (most / F.nullif(width, F.lit(0))))
    w = F.when(~known, 0).when(as_is, even(width)).otherwise(even(most))
    h = F.when(~known, 0).when(as_is, even(height)).otherwise(even(high))
    return F.struct(w.alias("width"), h.alias("height"))


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Seconds to wait after a refusal: what the server says, else 2, 4, 8, ... up to 60."""
    return F.coalesce(retry_after.cast("double"), F.least(F.pow(F.lit(2.0), attempt + 1), F.lit(60.0)))


def progress_percent(processed: Column, total: Column, running: Column) -> Column:
    return F.when(total > 0, F.round(processed * 100 / total)).when(running, 0).otherwise(100).cast("int")


def toggled(old: Column, clicked: Column) -> Column:
    """A click on the active arrow takes the vote back."""
    return F.when(old == clicked, 0).otherwise(clicked)


def optimistic(score: Column, old: Column, new: Column, accepted: Column) -> Column:
    """A score with a vote's change at once, and without it again if the vote isn't accepted."""
    return F.when(accepted, score + new - old).otherwise(score)


def indent(depth: Column) -> Column:
    return F.least(depth, F.lit(8)) * 16


def grid_columns(width: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(width / 154).cast("int"))


# Fields whose values are never shown, what stands in their place, and the longest body that is shown.
SENSITIVE = ["password", "token", "invite_token", "secret", "authorization", "session_id", "access_token", "refresh_token"]
HIDDEN, TOO_LARGE, NOT_JSON = "[REDACTED]", "[body too large to log]", "[non-JSON body]"
MOST_LOGGED = 2048


def redacted(body: Column, keys: list[str] | None = None) -> Column:
    """A JSON object with whole values of sensitive fields hidden, in objects within it too (not in arrays), its fields in order; null for no body.

    A body that is too large or no JSON object is replaced by a remark. Bodies are short, so their nesting is
    walked in Python, a batch at a time; Spark has no expression for any depth.
    """
    hidden = set(SENSITIVE if keys is None else keys)

    @F.pandas_udf("string")
    def mask(bodies: pd.Series) -> pd.Series:
        def walk(found: dict) -> dict:
            return {k: HIDDEN if k in hidden else walk(v) if isinstance(v, dict) else v for k, v in found.items()}

        def refuse(name: str) -> None:
            raise ValueError(name)

        def one(raw: str | None) -> str | None:
            try:
                found = json.loads(raw, parse_constant=refuse)
            except (ValueError, RecursionError):
                return NOT_JSON
            return json.dumps(walk(found), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if isinstance(found, dict) else NOT_JSON

        return bodies.map(one, na_action="ignore")

    size = F.octet_length(body)
    return F.when(size > MOST_LOGGED, TOO_LARGE).when(size > 0, mask(F.when((size > 0) & (size <= MOST_LOGGED), body)))
