"""Scalar functions as Columns: text, masking, hashing, calendars, sampling."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the search tokenizer.
STOP_WORDS = (
    "a about above after again against all am an and any are as at "
    "be because been before being below between both but by "
    "for from in into is it its of on or that the this to was with"
).split()


def tokens_words(c: Column) -> Column:
    """Lower-case ASCII words of two characters and more, without stop words: one regular expression, no lambda for every word."""
    stop = "|".join(STOP_WORDS)
    return F.regexp_extract_all(F.lower(c), F.lit(rf"(?<![a-z0-9_])(?!(?:{stop})(?![a-z0-9_]))[a-z0-9_]{{2,}}"), 0)


def tokens_plain(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores of two characters and more."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]{2,}"), 0)


def template(text: str, names: dict[str, Column]) -> Column:
    """Fills ``{{name}}`` and ``${name}``; what is missing or null is empty."""
    parts = re.split(r"\{\{\s*([\w.]+)\s*\}\}|\$\{\s*([\w.]+)\s*\}", text)
    out = []
    for i in range(0, len(parts), 3):
        out.append(F.lit(parts[i]))
        if i + 2 < len(parts):
            c = names.get(parts[i + 1] or parts[i + 2])
            out.append(F.lit("") if c is None else F.coalesce(c.cast("string"), F.lit("")))
    return F.concat(*out)


def mask_email(c: Column) -> Column:
    """``a***e@domain``; short names ``*@domain``; others ``***@masked.com``."""
    at = F.instr(c, "@")
    name, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    long = F.concat(F.left(name, F.lit(1)), F.lit("***"), F.right(name, F.lit(1)), F.lit("@"), domain)
    one = F.length(c) - F.length(F.replace(c, F.lit("@"), F.lit(""))) == 1
    return F.when((at == 0) | ~one, F.lit("***@masked.com")).when(F.length(name) <= 2, F.concat(F.lit("*@"), domain)).otherwise(long)


def bucket_label(c: Column, width: int) -> Column:
    """``30-39`` style labels."""
    low = (F.floor(c / width) * width).cast("long")
    return F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))


def pseudonym(c: Column, key: str, prefix: str = "anon_") -> Column:
    """HMAC-SHA256 of a text under ``key``, 16 hex digits, wholly in the JVM: the key pads are prepared here."""
    k = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    k = k.ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in k), bytes(x ^ 0x5C for x in k)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(c, "UTF-8")), 256))
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat(F.lit(bytearray(outer)), first), 256), F.lit(16)))


def run_length_encode(c: Column) -> Column:
    """``aaab`` -> ``3xa;1xb;``."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("ch"), F.lit(0).alias("n"))
    flush = lambda s: F.when(s["n"] > 0, F.concat(s["out"], s["n"].cast("string"), F.lit("x"), s["ch"], F.lit(";"))).otherwise(s["out"])
    step = lambda s, x: F.when((s["n"] > 0) & (s["ch"] == x), F.struct(s["out"].alias("out"), s["ch"].alias("ch"), (s["n"] + 1).alias("n"))).otherwise(F.struct(flush(s).alias("out"), x.alias("ch"), F.lit(1).alias("n")))
    return F.aggregate(chars, start, step, flush)


def run_length_decode(c: Column) -> Column:
    """The inverse of :func:`run_length_encode`."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)([0-9]+x.;)"), 1)
    return F.concat_ws("", F.transform(parts, lambda p: F.repeat(F.substring(p, F.length(p) - 1, F.lit(1)), F.regexp_extract(p, "^([0-9]+)x", 1).cast("int"))))


def poly_hash(c: Column, partitions: int) -> Column:
    """Partition of a key by the 31-polynomial hash in 32 bits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.pmod(F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + x))), F.lit(partitions)).cast("int")


def backoff(base_ms: Column, attempt: Column, cap_ms: int = 3_600_000) -> Column:
    """Exponential back-off with a cap."""
    return F.least(base_ms * F.pow(F.lit(2), attempt), F.lit(float(cap_ms)))


def age_priority(priority: Column, waited: Column, interval: int, step: int = 1) -> Column:
    """Priority after waiting: one step better per interval, 0 at best."""
    return F.greatest(F.lit(0), priority - F.floor(waited / interval) * step)


def is_business_day(d: Column, holidays: list[str] | tuple[str, ...] = ()) -> Column:
    """Monday to Friday and no holiday (ISO dates)."""
    weekday = ~F.dayofweek(d).isin(1, 7)
    return weekday & ~F.date_format(d, "yyyy-MM-dd").isin(list(holidays)) if holidays else weekday


def may_run(ts: Column, holidays: list[str] | tuple[str, ...] = (), start_hour: int = 9, end_hour: int = 17, blackouts: list[tuple[str, str]] | tuple = ()) -> Column:
    """Whether a time (UTC) is in working hours of a business day and in no blackout window (ISO times, both ends in)."""
    out = is_business_day(ts, holidays) & (F.hour(ts) >= start_hour) & (F.hour(ts) < end_hour)
    for a, b in blackouts:
        out &= ~ts.between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))
    return out


def in_daily_window(ts: Column, start_hour: int, end_hour: int) -> Column:
    """Whether the hour lies in [start, end), also over midnight."""
    h = F.hour(ts)
    return (h >= start_hour) & (h < end_hour) if start_hour <= end_hour else (h >= start_hour) | (h < end_hour)


def _field(spec: str, value: Column, low: int, high: int) -> Column:
    out = F.lit(False)
    for part in spec.split(","):
        span, _, step = part.partition("/")
        if not re.fullmatch(r"\*|\d+(-\d+)?", span) or (step and not step.isdigit()) or step == "0":
            raise ValueError(f"bad cron field {spec}")
        a, b = (low, high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]) if "-" in span or not step else high)
        if not low <= a <= b <= high:
            raise ValueError(f"cron field {spec} is out of {low}-{high}")
        out = out | (value.between(a, b) & ((value - a) % int(step or 1) == 0))
    return out


def cron_matches(expression: str, ts: Column) -> Column:
    """Whether a time (UTC) fits a five-field cron expression; day of month and day of week must both fit."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a cron expression has five fields")
    values = [F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.dayofweek(ts) - 1]
    out = F.lit(True)
    for f, v, (lo, hi) in zip(fields, values, [(0, 59), (0, 23), (1, 31), (1, 12), (0, 6)]):
        out = out & _field(f, v, lo, hi)
    return out


def recurrences(start: Column, freq: str, interval: int = 1, count: int | None = None, until: Column | None = None) -> Column:
    """Array of the times of a recurrence rule (DAILY, HOURLY, WEEKLY, MONTHLY, YEARLY; count or until)."""
    unit = {"MINUTELY": "minutes", "HOURLY": "hours", "DAILY": "days", "WEEKLY": "weeks", "MONTHLY": "months", "YEARLY": "years"}[freq.upper()]
    if count is None and until is None:
        raise ValueError("a recurrence needs a count or an end")
    each = {k: F.lit(0) for k in ("years", "months", "weeks", "days", "hours", "mins")}
    key = {"minutes": "mins"}.get(unit, unit)
    step = lambda i: F.make_interval(**{**each, key: i * interval})
    if count is None:
        return F.sequence(start, until, step(F.lit(1)))
    every = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: start + step(i))
    return every if until is None else F.filter(every, lambda t: t <= until)


def keep_sample(error: Column, duration_ms: Column, priority: Column, key: Column, rate: float, slow_ms: int = 1000) -> Column:
    """Errors, slow and priority rows always; others by a hash of the key."""
    return F.coalesce(error, F.lit(False)) | F.coalesce(duration_ms > slow_ms, F.lit(False)) | F.coalesce(priority, F.lit(False)) | (F.pmod(F.xxhash64(key), F.lit(10_000)) < int(rate * 10_000))


def laplace_noise(c: Column, sensitivity: float, epsilon: float, seed: int) -> Column:
    """The value with Laplace noise of scale sensitivity / epsilon."""
    u = F.rand(seed) - 0.5
    return c - F.lit(sensitivity / epsilon) * F.signum(u) * F.log(1 - 2 * F.abs(u) + F.lit(1e-12))


def euclid(a: Column, b: Column) -> Column:
    """Distance of two arrays of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def redact_struct(c: Column, kind, keys: list[str], mask: str = "***REDACTED***") -> Column:
    """Struct fields under (case-insensitive) keys replaced by ``mask``, in structs within structs too, but not in arrays; ``kind`` is the struct's type."""
    from pyspark.sql.types import StructType

    low = {k.lower() for k in keys}
    parts = []
    for f in kind.fields:
        inner = c[f.name]
        if f.name.lower() in low:
            parts.append(F.lit(mask).alias(f.name))
        elif isinstance(f.dataType, StructType):
            parts.append(redact_struct(inner, f.dataType, keys, mask).alias(f.name))
        else:
            parts.append(inner.alias(f.name))
    return F.when(c.isNotNull(), F.struct(*parts))


def redact(c: Column, keys: list[str]) -> Column:
    """Map values under (case-insensitive) keys replaced."""
    low = [k.lower() for k in keys]
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(low), F.lit("[REDACTED]")).otherwise(v))


def encrypt(c: Column, key: str) -> Column:
    """Deterministic field encryption (AES-ECB, base64); the key has 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(c, F.lit(key), F.lit("ECB"), F.lit("PKCS")))


def decrypt(c: Column, key: str) -> Column:
    """The inverse of :func:`encrypt`."""
    return F.aes_decrypt(F.unbase64(c), F.lit(key), F.lit("ECB"), F.lit("PKCS")).cast("string")


def snowflake_id(ts_ms: Column, worker: Column, seq: Column, epoch_ms: int = 1_704_067_200_000) -> Column:
    """Time-ordered 64-bit id."""
    return F.shiftleft((ts_ms - epoch_ms).cast("long"), 22).bitwiseOR(F.shiftleft(worker.cast("long"), 12)).bitwiseOR(seq.cast("long"))


def compare_versions(a: Column, b: Column) -> Column:
    """BEFORE, AFTER, EQUAL or CONCURRENT of two version vectors (maps; what is missing is 0)."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    more, less = F.exists(pairs, lambda d: d > 0), F.exists(pairs, lambda d: d < 0)
    return F.when(more & less, "CONCURRENT").when(more, "AFTER").when(less, "BEFORE").otherwise("EQUAL")


def merge_versions(a: Column, b: Column) -> Column:
    """Pointwise maximum."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))
