"""Calendar functions: month selectors, offsets, group keys and resampling bins of the time axis."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The initials of the months from January, twice, for runs that pass December.
INITIALS = "jfmamjjasondjfmamjjasond"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def months_of(selector: str | int) -> list[int]:
    """Months of a selector: a number, a name (its first three letters) or a run of initials (``djf``)."""
    text = str(selector).strip().lower()
    if "=" in text:
        text = text.split("=", 1)[1].strip()
    if re.fullmatch(r"\d{1,2}", text) and 1 <= int(text) <= 12:
        return [int(text)]
    if text[:3] in MONTHS and (len(text) == 3 or len(text) > 3 and text.isalpha() and text not in INITIALS):
        return [MONTHS.index(text[:3]) + 1]
    at = INITIALS.find(text)
    if at < 0 or not text or len(text) > 12:
        raise ValueError(f"not a month selector: {selector!r}")
    return [(at + k) % 12 + 1 for k in range(len(text))]


#: Units of an offset such as ``5y,3m,6d``.
UNITS = {"y": "years", "mi": "mins", "m": "months", "d": "days", "w": "weeks", "h": "hours", "s": "secs"}


def parse_offset(text: str) -> dict[str, int]:
    """``5y,3m,6d`` as years, months, weeks, days, hours, mins and secs."""
    out: dict[str, int] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"([+-]?\d+)\s*([a-z]+)", part.lower())
        unit = m and next((UNITS[u] for u in sorted(UNITS, key=len, reverse=True) if m[2].startswith(u)), None)
        if not unit:
            raise ValueError(f"not an offset: {text!r}")
        out[unit] = out.get(unit, 0) + int(m[1])
    return out


def interval(offset: str) -> Column:
    return F.make_interval(**{k: F.lit(v) for k, v in parse_offset(offset).items()})


def shift(t: Column, offset: str, sign: int, kind: str) -> Column:
    """``t`` moved by an offset, in the type that it has."""
    moved = t.cast("timestamp_ntz") + interval(offset) if sign > 0 else t.cast("timestamp_ntz") - interval(offset)
    return moved.cast(kind)


def season(t: Column) -> Column:
    m = F.month(t)
    return F.when(m.isin(12, 1, 2), "DJF").when(m <= 5, "MAM").when(m <= 8, "JJA").otherwise("SON")


#: Components of the calendar by which all years are pooled.
COMPONENTS = {
    "month": lambda t: F.month(t),
    "season": season,
    "year": lambda t: F.year(t),
    "day": lambda t: F.dayofmonth(t),
    "dayofyear": lambda t: F.dayofyear(t),
    "dayofweek": lambda t: F.weekday(t),
    "week": lambda t: F.weekofyear(t),
    "quarter": lambda t: F.quarter(t),
    "hour": lambda t: F.hour(t),
    "minute": lambda t: F.minute(t),
}
#: What the new dimension is called.
COMPONENT_NAMES = {"month": "m", "day": "d"}


def component(period: str) -> tuple[str, Column]:
    """Name and expression of a component of ``t``; accepts ``t.month`` as well."""
    key = period.split(".")[-1].lower()
    if key.rstrip("s") in COMPONENTS:
        key = key.rstrip("s")
    if key not in COMPONENTS:
        raise ValueError(f"no such period: {period!r}")
    return COMPONENT_NAMES.get(key, key), COMPONENTS[key](F.col("t"))


#: Names of frequencies and the aliases they stand for.
FREQUENCIES = {"month": "M", "months": "M", "season": "Q-FEB", "seasons": "Q-FEB", "quarter": "Q", "year": "Y", "years": "Y", "day": "D", "days": "D", "week": "W", "weeks": "W", "hour": "H", "hours": "H", "a": "Y", "min": "T", "ms": "MS", "ys": "YS"}


def parse_frequency(freq: str) -> tuple[int, str]:
    """Count and unit of an alias such as ``1D``, ``6H``, ``M`` or ``Q-FEB``."""
    text = freq.split(".")[-1].strip()
    m = re.fullmatch(r"(\d*)\s*([A-Za-z]+(?:-[A-Za-z]+)?)", text)
    if not m:
        raise ValueError(f"no such frequency: {freq!r}")
    unit = FREQUENCIES.get(m[2].lower(), m[2].upper())
    if unit not in ("M", "MS", "Y", "YS", "Q", "Q-FEB", "W", "D", "H", "T"):
        raise ValueError(f"no such frequency: {freq!r}")
    n = int(m[1] or 1)
    if n < 1 or n > 1 and unit not in ("D", "H", "T"):
        raise ValueError(f"no such frequency: {freq!r}")
    return n, unit


def bin_label(t: Column, freq: str) -> Column:
    """The label of the bin that holds ``t``: a date, or a timestamp under a day.

    Months, quarters and years end in their label; ``Q-FEB`` quarters end with
    February, May, August and November; weeks end on Sunday; days, hours and
    minutes begin with it, counted from 1970-01-01.
    """
    n, unit = parse_frequency(freq)
    if unit == "M":
        return F.last_day(t)
    if unit == "MS":
        return F.trunc(t, "month")
    if unit == "Y":
        return F.make_date(F.year(t), F.lit(12), F.lit(31))
    if unit == "YS":
        return F.trunc(t, "year")
    if unit == "Q":
        return F.last_day(F.add_months(F.trunc(t, "quarter"), 2))
    if unit == "Q-FEB":
        return F.last_day(F.add_months(F.trunc(F.add_months(t, 1), "quarter"), 1))
    day = F.to_date(t)
    if unit == "W":
        return F.date_add(day, 6 - F.weekday(day))
    if unit == "D":
        since = F.datediff(day, F.lit("1970-01-01").cast("date"))
        return day if n == 1 else F.date_add(F.lit("1970-01-01").cast("date"), F.floor(since / n).cast("int") * n)
    minutes = F.unix_micros(t.cast("timestamp_ntz").cast("timestamp")) / 60_000_000
    step = n * (60 if unit == "H" else 1)
    return F.timestamp_seconds(F.floor(minutes / step) * step * 60).cast("timestamp_ntz")


def bins_between(lo: Column, hi: Column, freq: str) -> Column:
    """All labels from ``lo`` to ``hi``, both of them labels."""
    n, unit = parse_frequency(freq)
    if unit in ("D", "W"):
        return F.sequence(lo, hi, F.make_interval(days=F.lit(7 if unit == "W" else n)))
    if unit in ("H", "T"):
        return F.sequence(lo, hi, F.make_dt_interval(mins=F.lit(n * (60 if unit == "H" else 1))))
    months = {"M": 1, "MS": 1, "Y": 12, "YS": 12, "Q": 3, "Q-FEB": 3}[unit]
    starts = F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.make_interval(months=F.lit(months)))
    return starts if unit in ("MS", "YS") else F.transform(starts, lambda d: F.last_day(d))


def contains(t: Column, start: str, end: str) -> Column:
    """Whether a time is in a closed range."""
    return t.cast("timestamp_ntz").between(F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end)))


def extended(start: Column, end: Column, offset: str, kind: str = "timestamp_ntz") -> tuple[Column, Column]:
    """A range that begins, or ends if the offset is positive, so much further out."""
    outward = next(iter(parse_offset(offset).values())) > 0
    return (start, shift(end, offset, 1, kind)) if outward else (shift(start, offset, 1, kind), end)


def bytes_of(text: str) -> int:
    """A size such as ``500M`` in bytes, by decimal units."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgtp]?)b?\s*", text.lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1000 ** " kmgtp".index(m[2] or " "))
