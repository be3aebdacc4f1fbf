"""Time-code expressions: clean, parse and format.

A time-code is ``MM:SS``, ``MM:SS.mmm`` or ``MM:SS:mmm``; there is no hour part, so ``00:01:23`` reads as
1 s 230 ms. Unreadable or null input gives NULL, never an error. Full-width digits count as digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the shape looked for in a noisy time-code.
TIMECODE_PATTERN = r"(\d{1,2}:\d{2}(?:[:.]\d{1,3})?)"
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"


def ascii_digits(c: Column) -> Column:
    return F.translate(c, WIDE_DIGITS, DIGITS)


def clean_timecode(c: Column) -> Column:
    """The first time-code inside the text, or the text itself where there is none."""
    found = F.regexp_extract(ascii_digits(c), TIMECODE_PATTERN, 1)
    return F.when(found == "", ascii_digits(c)).otherwise(found)


def _fraction(c: Column) -> Column:
    return F.substring(F.rpad(c, 3, "0"), 1, 3)


def parse_ms(c: Column) -> Column:
    """Milliseconds of a cleaned time-code (bigint). Minutes are unbounded and seconds unchecked."""
    head = F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", 1)).otherwise(c)
    parts = F.split(head, ":")
    colons = F.size(parts) - 1
    fraction = F.when(F.contains(c, F.lit(".")), F.get(F.split(c, r"\."), F.lit(1))).when(colons == 2, F.get(parts, F.lit(2))).when(colons == 1, F.lit("0"))
    milli = F.when(_fraction(fraction).rlike(r"^\d{3}$"), _fraction(fraction)).try_cast("bigint")
    # try_cast of a digit string trims blanks as the lenient integer reading does
    minutes, seconds = (F.get(parts, F.lit(i)) for i in (0, 1))
    whole = r"^\s*[+-]?\d+\s*$"
    ok = minutes.rlike(whole) & seconds.rlike(whole)
    return F.when(ok, F.trim(minutes).try_cast("bigint") * 60000 + F.trim(seconds).try_cast("bigint") * 1000 + milli)


def timecode_ms(c: Column) -> Column:
    """Clean and parse in one expression. The usual path runs the regular expression once: what it found is bound to a
    variable, as a plain expression would be evaluated again at each use inside a condition."""

    def usual(hit: Column) -> Column:
        colon = F.instr(hit, ":")
        return (
            F.substring(hit, F.lit(1), colon - 1).try_cast("bigint") * 60000
            + F.substring(hit, colon + 1, F.lit(2)).try_cast("bigint") * 1000
            + F.substring(F.rpad(F.substring(hit, colon + 4, F.lit(3)), 3, "0"), 1, 3).try_cast("bigint")
        )

    found = F.regexp_extract_all(ascii_digits(c), F.lit(TIMECODE_PATTERN), F.lit(1))
    return F.coalesce(F.get(F.transform(found, usual), F.lit(0)), parse_ms(ascii_digits(c)))


def format_timecode(ms: Column) -> Column:
    """``MM:SS.mmm``; minutes may exceed 99."""
    return F.format_string("%02d:%02d.%03d", (ms / 60000).cast("bigint"), (ms % 60000 / 1000).cast("bigint"), ms % 1000)


def format_srt(ms: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    return F.format_string(
        "%02d:%02d:%02d,%03d", (ms / 3600000).cast("bigint"), (ms % 3600000 / 60000).cast("bigint"), (ms % 60000 / 1000).cast("bigint"), ms % 1000
    )
