"""Column expressions: rounding, angles, flags, file names. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """NaN as null, so that it neither passes a comparison nor poisons a mean."""
    return F.when(~F.isnan(c), c)


def tenth(v: Column) -> Column:
    """Rounded to one decimal as the nearest whole of ten times the value, halves to even."""
    return F.rint(v * 10) / 10


def exact_tenth(v: Column) -> Column:
    """Rounded to one decimal by the exact binary value, halves to even.

    20 v is split into s + e without error; k is twice-tenths below it, and the rest decides.
    """
    p, q = v * 16, v * 4
    s = p + q
    b = s - p
    e = (p - (s - b)) + (q - b)
    k = F.floor(s / 2).cast("double")
    r = (s - 2 * k - 1) + e
    up = (r > 0) | ((r == 0) & (F.abs(k % 2) == 1))
    return (k + F.when(up, 1.0).otherwise(0.0)) / 10


def landmark(poses: Column, index: int, field: str) -> Column:
    """A field of one landmark; null where the array is too short."""
    return F.get(poses, F.lit(index))[field]


def joint_angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """The angle at b in degrees, to one decimal; a joint of no length has 90."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    cosine = (ux * vx + uy * vy) / (F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy) + 1e-6)
    return tenth(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def flag(condition: Column) -> Column:
    return condition.cast("int")


def deviation_category(symmetry_diff: Column, limit: float) -> Column:
    return F.when(symmetry_diff > limit, "red").otherwise("green")


def timestamp_ms(frame: Column, fps: Column) -> Column:
    """Whole milliseconds of a frame; without a rate, 30 frames a second."""
    return F.floor(frame / F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(30.0)) * 1000).cast("long")


def view_of(file_name: Column) -> Column:
    """side, front or angle by the end of a file name; null for other files."""
    found = F.regexp_extract(F.lower(file_name), r"_(side|front|angle)\.csv$", 1)
    return F.when(found != "", found)


def stem_of(file_name: Column) -> Column:
    return F.trim(F.regexp_replace(file_name, r"(?i)_(side|front|angle)\.csv$", ""))


def number_of(stem: Column) -> Column:
    """The leading digits, or the whole stem without any."""
    digits = F.regexp_extract(stem, r"^([0-9]+)", 1)
    return F.when(digits != "", digits).otherwise(stem)


def label_of(stem: Column) -> Column:
    """0 for good, 1 for bad, null for neither; good wins."""
    low = F.lower(stem)
    return F.when(low.contains("good"), 0).when(low.contains("bad"), 1)


def lift_id_of(stem: Column) -> Column:
    """Number and label word: one lift's views share it, and a number used for a good and a bad lift gives two."""
    word = F.when(label_of(stem) == 0, "good").when(label_of(stem) == 1, "bad").otherwise("unlabeled")
    return F.concat(number_of(stem), word)


def phase_of(position: Column, n: Column) -> Column:
    """early, middle or final third of n rows, cut at n // 3 and 2 n // 3."""
    return F.when(position < F.floor(n / 3), "early").when(position < F.floor(2 * n / 3), "middle").otherwise("final")
