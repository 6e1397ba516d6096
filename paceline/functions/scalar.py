"""Scalar functions of the rating engine, all built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Time zones of venues, hours from UTC.
UTC_OFFSET = {
    "America/New_York": -5,
    "America/Detroit": -5,
    "America/Indiana/Indianapolis": -5,
    "America/Kentucky/Louisville": -5,
    "America/Chicago": -6,
    "America/Denver": -7,
    "America/Phoenix": -7,
    "America/Boise": -7,
    "America/Los_Angeles": -8,
    "America/Anchorage": -9,
    "Pacific/Honolulu": -10,
    "America/Indiana/Knox": -6,
    "America/Menominee": -6,
    "America/North_Dakota/Center": -6,
}


def win_probability(diff: Column, scale: float = 400.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -diff / scale))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clipped(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clipped(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def log_loss(p: Column, y: Column, eps: float = 1e-12) -> Column:
    q = clipped(p, eps, 1 - eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def decay(rate: float, seasons_back: Column) -> Column:
    """``rate`` to the number of seasons; 0 to the 0 is 1."""
    return F.pow(F.lit(rate), seasons_back)


def half_life(days: Column, hl: float) -> Column:
    return F.pow(F.lit(0.5), days / hl)


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between timestamps, floored; calendar days would count a midnight between as one."""
    return F.floor((_seconds(later) - _seconds(earlier)) / 86400)


def _seconds(t: Column) -> Column:
    """Seconds of the clock's reading, whatever the session's zone and with or without a zone of its own."""
    return F.unix_date(t.cast("date")) * F.lit(86400).cast("long") + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def margin_multiplier(margin: Column, winner_diff: Column) -> Column:
    return F.ln(F.abs(margin) + 1) * 2.2 / (0.001 * winner_diff + 2.2)


def pythagorean(pf: Column, pa: Column, power: float = 2.37) -> Column:
    a, b = F.pow(F.greatest(pf, F.lit(1e-6)), F.lit(power)), F.pow(F.greatest(pa, F.lit(1e-6)), F.lit(power))
    return a / (a + b)


def decimal_odds(american: Column) -> Column:
    return F.when(american < 0, 1 + 100 / F.abs(american)).otherwise(1 + american / 100)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(h))


def utc_offset(zone: Column) -> Column:
    """Hours from UTC of a known zone; null for any other or none."""
    table = F.create_map(*[F.lit(x) for kv in UTC_OFFSET.items() for x in kv])
    return F.try_element_at(table, zone)


def first_price(prices: Column) -> Column:
    """1 if the first of a stringified list is over a half, else 0; null if it can't be read."""
    read = F.from_json(F.translate(prices, "'", '"'), "array<string>")
    value = F.get(read, 0).try_cast("double")
    return F.when(value.isNotNull(), (value > 0.5).cast("int"))


def calibration_bin(p: Column, bins: int = 10) -> Column:
    """Half-open bins; 1 is in the last. Edges are compared, not computed by division."""
    out = F.lit(bins - 1)
    for k in range(bins - 1, 0, -1):
        out = F.when(p < k / bins, k - 1).otherwise(out)
    return F.when(p.isNotNull(), out)


def right_closed(x: Column, edges: tuple[float, ...]) -> Column:
    """Label ``(lo,hi]``; null at or under the first edge and over the last."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:]):
        out = F.when((x > lo) & (x <= hi), f"({lo:g},{hi:g}]" if math.isfinite(hi) else f"({lo:g},inf]").otherwise(out)
    return out


def left_closed(x: Column, edges: tuple[float, ...]) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:]):
        out = F.when((x >= lo) & (x < hi), f"[{lo:g},{hi:g})").otherwise(out)
    return out


def week_band(week: Column) -> Column:
    """Five phases of a season."""
    return F.when(week <= 1, "1").when(week <= 4, "2-4").when(week <= 9, "5-9").when(week <= 13, "10-13").otherwise("14+")


def week_phase(week: Column) -> Column:
    """Four phases, as figures by week show them."""
    return F.when(week <= 1, "1").when(week <= 4, "2-4").when(week <= 9, "5-9").otherwise("10+")


def week_third(week: Column) -> Column:
    """The bands that stacks are fitted by."""
    return F.when(week <= 3, "0-3").when(week <= 8, "4-8").otherwise("9+")
