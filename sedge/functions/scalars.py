"""Small scalar rules as Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of a provider's batch job.
PROVIDER_STATES = {
    "Pending": ("queued", "pending", "unspecified"),
    "Running": ("running", "updating", "paused"),
    "Succeeded": ("succeeded",),
    "Failed": ("partially_succeeded", "failed", "cancelled", "cancelling", "expired"),
}
MIME = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def expand_csv(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def nth_int(c: Column, n: int) -> Column:
    """The n-th number (from 1) of a comma list that parses; null where there are fewer."""
    return F.try_element_at(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull()), F.lit(n))


def last_segment(url: Column) -> Column:
    return F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)


def date_path(prefix: str, date: Column, name: Column, extension: str) -> Column:
    """prefix/year/month/day/name.extension without zero padding."""
    parts = [F.split(date, "-")[i].cast("int").cast("string") for i in range(3)]
    return F.concat_ws("/", F.lit(prefix), *parts, F.concat(name, F.lit(f".{extension}")))


def is_slug(c: Column) -> Column:
    return c.rlike("^[a-z0-9-]{1,32}$")


def human_size(size: Column) -> Column:
    """1024 steps; bytes exactly, larger units with two decimals."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(size >= 1024**i, F.format_string(f"%.2f {unit}", size / float(1024**i))).otherwise(out)
    return out


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def format_ms(ms: Column) -> Column:
    at = F.timestamp_add("SECOND", F.floor(ms / 1000), F.lit("1970-01-01").cast("timestamp_ntz"))
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def display_name(c: Column) -> Column:
    clean = F.regexp_replace(c, "[^A-Za-z0-9_-]", "-")
    return F.concat(F.lit("structured-"), F.substring(F.when(clean == "", "job").otherwise(clean), 1, 40))


def provider_state(c: Column) -> Column:
    out = F.lit("Pending")
    for state, names in PROVIDER_STATES.items():
        out = F.when(c.isin(*names), state).otherwise(out)
    return out


def mime_type(path: Column) -> Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    out = F.lit(None).cast("string")
    for e, mime in MIME.items():
        out = F.when(ext == e, mime).otherwise(out)
    return out


def backoff_ms(retries: Column, base_ms: int, max_ms: int, jitter: Column | None = None) -> Column:
    """min(base * 2 ** min(n, 20), max), times a jitter factor of 0.9 to 1.1, kept in [base, max]."""
    delay = F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.least(retries, F.lit(20))), F.lit(float(max_ms)))
    delay = delay if jitter is None else delay * jitter
    return F.greatest(F.lit(base_ms), F.least(F.lit(max_ms), F.floor(delay).cast("long"))).cast("long")


def upper_median(values: Column) -> Column:
    """Element n div 2 of the sorted finite values; null where there are none."""
    finite = F.array_sort(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return F.try_element_at(finite, (F.floor(F.size(finite) / 2) + 1).cast("int"))


def finite(c: Column) -> Column:
    """The number where it is finite, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def fallback_budget(n: Column) -> Column:
    return F.greatest(F.lit(512), F.least(F.lit(2048), n))


def resize_edge(edge: Column, longest: Column, most: int) -> Column:
    """An image edge scaled so that the longest edge becomes ``most``; at least 1."""
    return F.greatest(F.lit(1), F.round(edge * F.lit(float(most)) / longest).cast("int"))


def image_prompt(c: Column, tag: str = "<image>") -> Column:
    return F.when(F.ltrim(c).startswith(tag), c).otherwise(F.concat(F.lit(f"{tag}\n"), c))


def attachment(content: Column) -> Column:
    """Bytes as base64 without line breaks."""
    return F.regexp_replace(F.base64(content.cast("binary")), r"[\r\n]", "")


def _address(c: Column) -> Column:
    """The text where it is an IPv4 or IPv6 address, else null."""
    four = c.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    groups = F.size(F.filter(F.split(c, ":"), lambda x: x != ""))
    double = F.regexp_count(c, F.lit("::")) == 1
    shape = c.rlike("^[0-9A-Fa-f:]+$") & ~c.rlike("[0-9A-Fa-f]{5}|:::") & (double | ~c.rlike("^:|:$"))
    six = shape & F.when(double, groups <= 7).otherwise((groups == 8) & (F.regexp_count(c, F.lit(":")) == 7))
    return F.when(four | six, c)


def client_ip(peer: Column, forwarded_for: Column, forwarded: Column, trusted: Sequence[str], mode: str = "off") -> Column:
    """The client's address: the peer's, or what a trusted peer's header says.

    ``mode`` is off, x-forwarded-for (its first entry) or forwarded (its first ``for=`` that is an address).
    """
    if mode == "off" or not trusted:
        return peer
    if mode == "x-forwarded-for":
        said = _address(F.trim(F.substring_index(forwarded_for, ",", 1)))
    elif mode == "forwarded":
        parts = F.transform(F.split(forwarded, "[;,]"), lambda p: F.trim(p))
        named = F.transform(F.filter(parts, lambda p: p.startswith("for=")), lambda p: _address(F.regexp_replace(F.substr(p, F.lit(5)), '^"+|"+$', "")))
        said = F.try_element_at(F.array_compact(named), F.lit(1))
    else:
        raise ValueError(f"unknown proxy mode {mode}")
    return F.when(peer.isin(*trusted), F.coalesce(said, peer)).otherwise(peer)


def source_url(url: Column, source: Column, default: str, other: str, default_other: str) -> Column:
    """The URL to scan: the default of source ``other`` replaces the general default, a URL given stays."""
    return F.when((source == other) & (url == default), F.lit(default_other)).otherwise(url)
