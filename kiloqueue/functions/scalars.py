"""Scalar column functions (X-*, N-*): dates, flags, labels, formatting.

Everything returns a ``Column`` built from native functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, here and in the label functions below: texts and thresholds of the rules.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DAY_SHORT = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
CYCLIC_PERIODS = {"hour": ("hour_of_day", 24), "day": ("day_of_week", 7), "month": ("month", 12)}


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


# --- X-01..X-06: time --------------------------------------------------------

def lenient_timestamp(col) -> Column:
    """X-01: parse, bad values become null."""
    c = _c(col)
    return F.try_to_timestamp(c.cast("string"))


def day_of_week(ts) -> Column:
    """X-02: Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def is_weekend(dow) -> Column:
    return (_c(dow) >= 5).cast("int")


def is_rush_hour(hour) -> Column:
    h = _c(hour)
    return (h.between(7, 9) | h.between(16, 19)).cast("int")


def part_of_day(hour) -> Column:
    h = _c(hour)
    return (F.when((h >= 5) & (h < 12), 1).when((h >= 12) & (h < 17), 2)
            .when((h >= 17) & (h < 21), 3).otherwise(0))


def cyclic(col, period: int) -> tuple[Column, Column]:
    """X-06: sin / cos of 2*pi*x/period."""
    angle = F.lit(2 * math.pi) * _c(col) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


# --- X-07..X-11: interactions -------------------------------------------------

def traffic_level(score) -> Column:
    """X-08: [0,.33] -> 0, (.33,.66] -> 1, (.66,1] -> 2, else null (double)."""
    s = _c(score)
    return (F.when((s >= 0) & (s <= 0.33), 0.0).when((s > 0.33) & (s <= 0.66), 1.0)
            .when((s > 0.66) & (s <= 1.0), 2.0))


def congestion_score(current_speed, free_flow_speed) -> Column:
    """X-10: clamp(1 - current/free, 0, 1) rounded to 4; free = 0 gives 0; missing speeds are 50."""
    cur = F.coalesce(_c(current_speed).cast("double"), F.lit(50.0))
    free = F.coalesce(_c(free_flow_speed).cast("double"), F.lit(50.0))
    ratio = F.try_divide(cur, free)
    return F.when(free == 0, F.lit(0.0)).otherwise(
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - ratio)), 4))


def clip(col, lo, hi) -> Column:
    """X-14 / P-20."""
    return F.least(F.greatest(_c(col), F.lit(lo)), F.lit(hi))


# --- X-19..X-29: labels and text ---------------------------------------------

def availability_label(utilisation) -> Column:
    """X-19."""
    u = _c(utilisation)
    return (F.when(u < 0.4, "Available").when(u < 0.7, "Moderate")
            .when(u < 0.9, "Busy").otherwise("Full"))


def snapshot_availability(active, n) -> Column:
    """X-20: active sessions against connector count."""
    a, n = _c(active), _c(n)
    return (F.when(a < 0.4 * n, "Available").when(a < 0.7 * n, "Moderate")
            .when(a < n, "Busy").otherwise("Full"))


def snapshot_wait(active, n, queue) -> Column:
    """X-21: active/max(n,1)*20 + queue*3, at least 0."""
    return F.greatest(F.lit(0.0), _c(active) / F.greatest(_c(n), F.lit(1)) * 20.0 + _c(queue) * 3.0)


def wait_recommendation(wait, available) -> Column:
    """X-22."""
    w, a = _c(wait), _c(available)
    return (F.when((w <= 5) & (a > 0), "GO_NOW").when(w <= 15, "GOOD_TIME")
            .when(w <= 30, "MODERATE_WAIT").when(w <= 60, "LONG_WAIT").otherwise("AVOID"))


def action_label(wait, available) -> Column:
    """X-23 (plain text)."""
    w, a = _c(wait), _c(available)
    return (F.when(a <= 0, "FULL").when(w < 10, "RECOMMENDED")
            .when(w < 30, "MODERATE WAIT").otherwise("HIGH WAIT"))


def wait_level(wait, inclusive: bool = True) -> Column:
    """X-24: bands 5/15/30; ``inclusive`` uses <= (client helper), else < (badge)."""
    w = _c(wait)
    le = (lambda x: w <= x) if inclusive else (lambda x: w < x)
    return (F.when(le(5), "GO NOW").when(le(15), "GOOD TIME").when(le(30), "MODERATE WAIT")
            .otherwise("LONG WAIT"))


def traffic_label(score) -> Column:
    """X-25."""
    s = _c(score)
    return (F.when(s < 0.2, "Free Flow").when(s < 0.4, "Light").when(s < 0.6, "Moderate")
            .when(s < 0.8, "Heavy").otherwise("Gridlock"))


def utilisation_pct(ports, available) -> Column:
    """X-26: rounded percent, 0 when ports are 0 or null."""
    p, a = _c(ports), _c(available)
    return F.when(p.isNull() | (p == 0), F.lit(0.0)).otherwise(
        F.round((p - a) / p * 100.0, 0))


def hour_label(hour) -> Column:
    """X-27: HH:00."""
    return F.concat(F.lpad(_c(hour).cast("string"), 2, "0"), F.lit(":00"))


def hour_label_12h(hour) -> Column:
    """X-27: 12 AM, 1 AM, ..., 12 PM, ..., 11 PM."""
    h = _c(hour)
    h12 = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.concat(h12.cast("string"), F.when(h < 12, F.lit(" AM")).otherwise(F.lit(" PM")))


def day_label(dow, short: bool = False) -> Column:
    """X-27: Monday / Mon for 0..6."""
    names = DAY_SHORT if short else DAY_NAMES
    return F.element_at(F.array(*[F.lit(n) for n in names]), _c(dow).cast("int") + 1)


def format_wait(minutes) -> Column:
    """X-28: '< 1 min', 'n min' (half to even, so .5 goes to the even minute), 'h m'."""
    m = _c(minutes)
    return (F.when(m < 1, F.lit("< 1 min"))
            .when(m < 60, F.concat(F.bround(m, 0).cast("long").cast("string"), F.lit(" min")))
            .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h "),
                                F.floor(F.pmod(m, F.lit(60.0))).cast("long").cast("string"), F.lit("m"))))


def format_distance(km) -> Column:
    """X-29: metres under 1 km, else one-decimal km."""
    d = _c(km)
    return (F.when(d < 1.0, F.concat(F.floor(d * 1000).cast("long").cast("string"), F.lit(" m")))
            .otherwise(F.format_string("%.1f km", d)))


def safe_double(col, default: float = 0.0) -> Column:
    """X-30."""
    return F.coalesce(_c(col).cast("string").try_cast("double"), F.lit(default))


def safe_int(col, default: int = 0) -> Column:
    """X-30: only exact integer text converts ('3.7' gives the default)."""
    return F.coalesce(F.trim(_c(col).cast("string")).try_cast("int"), F.lit(default))


def cache_key(*cols) -> Column:
    """X-31: first 12 hex chars of md5 of the '_'-joined values; a null counts as the text 'None'."""
    return F.substring(F.md5(F.concat_ws("_", *[F.coalesce(_c(c).cast("string"), F.lit("None")) for c in cols])), 1, 12)


def routing_url(lat, lng) -> Column:
    """X-32: directions link (fixed 6-decimal coordinates)."""
    return F.format_string(
        "https://www.google.com/maps/dir/?api=1&destination=%.6f,%.6f&travelmode=driving",
        _c(lat), _c(lng))


def iso_utc(ts) -> Column:
    """X-33."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def residuals(y_true, y_pred) -> dict[str, Column]:
    """X-36."""
    t, p = _c(y_true), _c(y_pred)
    r = t - p
    return {"residual": r, "abs_residual": F.abs(r),
            "pct_error": F.when(t != 0, r / t * 100.0)}
