"""Arithmetic on what a media probe reports: durations, frame rates, tolerances, sizes. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20


def duration_ms(seconds: Column) -> Column:
    """Whole milliseconds of a number of seconds, given as text; cut off, not rounded."""
    return (seconds.try_cast("double") * 1000).cast("bigint")


def frame_rate(text: Column) -> Column:
    """``30000/1001`` or ``25``; null for a zero or missing denominator."""
    parts = F.split(text, "/")
    number = [F.get(parts, F.lit(i)).try_cast("double") for i in (0, 1)]
    return F.when(F.contains(text, F.lit("/")), F.try_divide(*number)).otherwise(number[0])


def tolerance_ms(base: Column | int, fps: Column) -> Column:
    """Below one frame a second, a frame's duration is added."""
    b = base if isinstance(base, Column) else F.lit(base)
    return b + F.when(fps < 1, F.floor(1000 / fps)).otherwise(0).cast("bigint")


def same_stream(duration: Column, other_duration: Column, fps: Column, other_fps: Column, tolerance: Column) -> Column:
    """Whether a stored re-encoding can stand for the wanted one: durations and frame rates strictly within the tolerance and 0.01.
    What can't be probed can't stand for it."""
    return F.coalesce((F.abs(duration - other_duration) < tolerance) & (F.abs(fps - other_fps) < 0.01), F.lit(False))


def split_reusable(total: Column, whole: Column, n: Column, tolerance: int) -> Column:
    """Whether stored segments still make up the whole: strictly within the tolerance per segment."""
    return F.abs(whole - total) < n * tolerance


def bits_per_second(kilobytes: Column) -> Column:
    return kilobytes * 1024 * 8


def buffer_bits(kilobytes: Column) -> Column:
    """The rate buffer: two seconds of the bit rate."""
    return bits_per_second(kilobytes) * 2


def key_frame_distance(fps: Column) -> Column:
    return F.floor(fps * 10).cast("int")


def at_least_mib(size_bytes: Column, threshold_mib: float) -> Column:
    """Whether a file is large enough to be worth re-encoding; a threshold of 0 takes all."""
    return F.lit(threshold_mib == 0) | (size_bytes / MIB >= threshold_mib)
