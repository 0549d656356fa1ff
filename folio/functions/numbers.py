"""Settings values: bounded numbers, allow-lists and clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import js


def number(c: Column) -> Column:
    """A string as a number: blank is 0, what isn't a finite number is null."""
    t = js.trim(c)
    v = F.when(t == "", F.lit(0.0)).otherwise(t.try_cast("double"))
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)


def bounded(value: Column, present: Column, fallback: float, low: float, high: float) -> Column:
    """A setting: null that is present counts as 0; what is absent or no number takes the fallback."""
    v = F.when(~present, F.lit(None)).when(value.isNull(), F.lit(0.0)).otherwise(number(value))
    # greatest and least skip nulls
    return F.when(v.isNull(), F.lit(float(fallback))).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)))


def allowed(c: Column, values: list[str], default: str) -> Column:
    return F.when(c.isin(values), c).otherwise(F.lit(default))


def run_limits(rpm: Column, concurrency: Column, retries: Column) -> list[Column]:
    """Requests a minute (1 to 600), workers (1 to 20), retries (0 to 5); 0 means the default only for the first two."""

    def clamp(v: Column, low: int, high: int) -> Column:
        return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))

    first = clamp(F.coalesce(F.nullif(rpm, F.lit(0.0)), F.lit(10.0)), 1, 600)
    second = clamp(F.coalesce(F.nullif(concurrency, F.lit(0.0)), F.lit(1.0)), 1, 20)
    third = clamp(F.coalesce(retries, F.lit(0.0)), 0, 5)
    return [first.alias("rpm"), second.alias("concurrency"), third.alias("retries")]


EFFORTS = ["low", "medium", "high", "xhigh", "max"]


def effort(c: Column) -> Column:
    return allowed(F.lower(js.trim(js.text(c))), EFFORTS, "")


def image_size(width: Column, height: Column, box: tuple[int, int] = (620, 690)) -> tuple[Column, Column]:
    """A picture's size inside a box, never enlarged; 640 x 360 where a side is missing or 0."""
    w = F.greatest(F.lit(1.0), F.coalesce(F.nullif(width.cast("double"), F.lit(0.0)), F.lit(640.0)))
    h = F.greatest(F.lit(1.0), F.coalesce(F.nullif(height.cast("double"), F.lit(0.0)), F.lit(360.0)))
    scale = F.least(F.lit(1.0), F.lit(float(box[0])) / w, F.lit(float(box[1])) / h)
    return F.greatest(F.lit(1), js.half_up(w * scale)), F.greatest(F.lit(1), js.half_up(h * scale))
