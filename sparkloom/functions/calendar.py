"""Calendar functions and format-preserving encryption as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.scalar import is_business_day


def _values(spec: str, low: int, high: int) -> list[int]:
    """The values of a cron field."""
    out: set[int] = set()
    for part in spec.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        try:
            lo, hi, by = (low, high, int(step or 1)) if span == "*" else (int(a), int(b) if b else high if step else int(a), int(step or 1))
        except ValueError as e:
            raise ValueError(f"bad cron field {spec}") from e
        if by < 1 or not low <= lo <= hi <= high:
            raise ValueError(f"bad cron field {spec}")
        out.update(range(lo, hi + 1, by))
    return sorted(out)


def next_cron(expression: str, ts: Column) -> Column:
    """The first minute after ``ts`` that fits (within a year and a day; else null). Day of month and day of week must both fit.

    The minutes of a fitting day are known beforehand, so only days are searched.
    """
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a cron expression has five fields")
    minute, hour, dom, month, dow = (_values(f, *r) for f, r in zip(fields, [(0, 59), (0, 23), (1, 31), (1, 12), (0, 6)]))
    times = F.array(*[F.lit(h * 60 + m) for h in hour for m in minute])
    fits = lambda d: F.dayofmonth(d).isin(dom) & F.month(d).isin(month) & (F.dayofweek(d) - 1).isin(dow)
    day = F.to_date(ts)
    later = F.get(F.filter(times, lambda t: t > F.hour(ts) * 60 + F.minute(ts)), F.lit(0))
    today = F.when(fits(day) & later.isNotNull(), later)
    other = F.get(F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, 366)), fits), F.lit(0))
    at = lambda d, m: F.timestamp_add("MINUTE", m, d.cast("timestamp_ntz"))
    return F.when(today.isNotNull(), at(day, today)).otherwise(at(other, F.lit(hour[0] * 60 + minute[0])))


def next_business_day(d: Column, holidays: list[str] | tuple[str, ...] = (), within: int = 31) -> Column:
    """The day itself or the first business day after it (null if none is within so many days)."""
    return F.get(F.filter(F.sequence(F.to_date(d), F.date_add(F.to_date(d), within)), lambda x: is_business_day(x, holidays)), F.lit(0))


def utc_offset_hours(ts: Column, zone: str) -> Column:
    """Hours by which a zone's clock is ahead of UTC at a time."""
    return (F.unix_seconds(F.from_utc_timestamp(ts, zone)) - F.unix_seconds(ts.cast("timestamp"))) / 3600


def _feistel(c: Column, key: str, rounds: int, sign: int) -> Column:
    n = F.length(c)
    la = F.floor(n / 2).cast("int")
    a, b = F.substring(c, F.lit(1), la), F.substring(c, la + 1, n)

    def moved(x: Column, other: Column, k: int) -> Column:
        size = F.length(x)
        ten = F.concat(F.lit("1"), F.repeat(F.lit("0"), size)).cast("decimal(38,0)")
        noise = F.conv(F.left(F.sha2(F.concat(F.lit(f"{key}:{k}:"), other), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
        return F.lpad(F.pmod(x.cast("decimal(38,0)") + sign * noise, ten).cast("decimal(38,0)").cast("string"), size, "0")

    def turn(k: int):
        if k % 2 == 0:
            return lambda s: F.struct(moved(s["a"], s["b"], k).alias("a"), s["b"].alias("b"))
        return lambda s: F.struct(s["a"].alias("a"), moved(s["b"], s["a"], k).alias("b"))

    order = range(rounds) if sign > 0 else range(rounds - 1, -1, -1)
    state = F.struct(a.alias("a"), b.alias("b"))
    for k in order:
        state = F.transform(F.array(state), turn(k))[0]
    out = F.concat(state["a"], state["b"])
    return F.when(c.rlike("^[0-9]{2,36}$"), out).otherwise(c)


def encrypt_digits(c: Column, key: str, rounds: int = 4) -> Column:
    """Digits of the same number for 2 to 36 digits (a balanced network of keyed rounds); other texts stay."""
    return _feistel(c, key, rounds, 1)


def decrypt_digits(c: Column, key: str, rounds: int = 4) -> Column:
    """The inverse of :func:`encrypt_digits`."""
    return _feistel(c, key, rounds, -1)
