"""Predicates on fields, as boolean columns for ``filter``. Those on plain columns reach the scan."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STASH_CODE = re.compile(r"m\d{2}s\d{2}i\d{3}")
#: Names of quantities that are sums or means by nature.
SUMMED = ("lightning",)
SUMMED_AMOUNT = re.compile(r"surface_microphysical.*amount")
MEANED = ("albedo", "ocean_chlorophyll")


def stash(code: str) -> Column:
    return F.col("stash") == code


def variable(names: str | list[str]) -> Column:
    """A STASH code, or any of some long, standard or variable names. The 10 m wind speed lets its components through."""
    names = [names] if isinstance(names, str) else list(names)
    codes = [n for n in names if STASH_CODE.fullmatch(n)]
    names = [n for n in names if n not in codes]
    if "wind_speed_at_10m" in names:
        names += ["eastward_wind_at_10m", "northward_wind_at_10m"]
    found = reduce(lambda a, b: a | b, (F.col(c).isin(names) for c in ("variable", "standard_name", "var_name")))
    found = F.coalesce(found, F.lit(False)) if names else F.lit(False)
    return found | F.coalesce(F.col("stash").isin(codes), F.lit(False)) if codes else found


def level(level_type: str, levels: list[float] | str) -> Column:
    """"*": on any level of the type; []: on none; else on one of ``levels``."""
    own = F.col("level_type") == level_type
    if levels == "*":
        return F.coalesce(own & F.col("level").isNotNull(), F.lit(False))
    if not levels:
        return F.coalesce(~own, F.lit(True)) | F.col("level").isNull()
    return F.coalesce(own & F.col("level").isin([float(x) for x in levels]), F.lit(False))


def not_level(value: float = 0) -> Column:
    return F.col("level") != float(value)


def cell_methods(methods: list[str], name: str = "", coord: str | None = None, interval: str | None = None, comment: str | None = None) -> Column:
    """No methods: only point values, but for quantities that are sums or means by nature. Else each given method is present."""
    column = F.coalesce(F.col("cell_methods"), F.array().cast("array<struct<method:string,coord:string,interval:string,comment:string>>"))

    def fits(method: str):
        def test(m: Column) -> Column:
            wanted = {"method": method, "coord": coord, "interval": interval, "comment": comment}
            return F.coalesce(reduce(lambda a, b: a & b, (m.getField(k) == v for k, v in wanted.items() if v is not None)), F.lit(False))

        return test

    if methods:
        return reduce(lambda a, b: a & b, (F.exists(column, fits(m)) for m in methods))
    only = "sum" if any(s in name for s in SUMMED) or SUMMED_AMOUNT.search(name) else "mean" if any(s in name for s in MEANED) else None
    if only:
        return (F.size(column) > 0) & F.forall(column, lambda m: F.coalesce(m.getField("method") == only, F.lit(False)))
    return F.forall(column, lambda m: F.coalesce(m.getField("method") == "point", F.lit(False)))


def parse_time(text: str) -> tuple[datetime, datetime]:
    """First and last instant of an ISO time of any precision, in UTC."""
    m = re.fullmatch(r"(\d{4})(?:-?(\d{2})(?:-?(\d{2})(?:[T ]?(\d{2})(?::?(\d{2})(?::?(\d{2}))?)?)?)?)?(Z|[+-]\d{2}:?\d{2})?", text)
    if not m:
        raise ValueError(f"not an ISO time: {text}")
    parts = [int(x) for x in m.groups()[:6] if x is not None]
    start = datetime(*(parts + [1, 1, 1][len(parts) :] if len(parts) < 3 else parts))
    if len(parts) == 1:
        end = start.replace(year=start.year + 1)
    elif len(parts) == 2:
        end = (start + timedelta(days=31)).replace(day=1)
    else:
        end = start + {3: timedelta(days=1), 4: timedelta(hours=1), 5: timedelta(minutes=1), 6: timedelta(seconds=1)}[len(parts)]
    zone = m[7]
    if zone and zone != "Z":
        shift = timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:])) * (-1 if zone[0] == "-" else 1)
        start, end = start - shift, end - shift
    return start, end - timedelta(microseconds=1)


def time_range(start: str, end: str | None = None) -> Column:
    """Both ends included; without an end, all instants of ``start`` at its own precision."""
    first, last = parse_time(start)
    last = parse_time(end)[0] if end else last
    return F.col("time").between(F.lit(f"{first}+00:00").cast("timestamp"), F.lit(f"{last}+00:00").cast("timestamp"))


def area(lat_start=None, lat_end=None, lon_start=None, lon_end=None) -> Column:
    """Strictly inside a box; a box over the date line has lon_end < lon_start. All None: everything."""
    bounds = (lat_start, lat_end, lon_start, lon_end)
    if all(b is None for b in bounds):
        return F.lit(True)
    if any(not isinstance(b, (int, float)) or isinstance(b, bool) for b in bounds):
        raise TypeError("an area needs four numbers or none")
    x = F.col("x")
    if lon_end < lon_start:
        lon_end, x = lon_end + 360, F.when(x < lon_start, x + 360).otherwise(x)
    y = F.col("y")
    return (y > float(lat_start)) & (y < float(lat_end)) & (x > float(lon_start)) & (x < float(lon_end))


def not_member(member: int = 0) -> Column:
    return F.col("realization") != member


def members(wanted: int | list[int]) -> Column:
    return F.col("realization").isin([wanted] if isinstance(wanted, int) else list(wanted))


def hours(start: int, end: int | None = None) -> Column:
    end = start if end is None else end
    if not (0 <= start <= 23 and 0 <= end <= 23):
        raise ValueError("hours of the day are 0 to 23")
    return F.hour("time").between(start, end)


def attribute(name: str, value: str | None = None) -> Column:
    has = F.coalesce(F.map_contains_key("attributes", name), F.lit(False))
    return has if value is None else has & F.coalesce(F.col("attributes")[name] == value, F.lit(False))


def combine(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
