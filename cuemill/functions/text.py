"""Text expressions: Unicode strip, comparison keys, line breaks and merging of two languages. Null in, null out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANK = r"[\s\x1c-\x1f\x85]"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (plain ``trim`` takes only the space)."""
    return F.regexp_replace(c, rf"(?U)^{_BLANK}+|{_BLANK}+\z", "")


def fold(c: Column) -> Column:
    """Case folding inside the JVM: lower case, and sharp s as two letters. For other foldings see ``casefold``."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Exact Unicode case folding, for text with ligatures or final sigmas."""
    return s.str.casefold()


def without_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def normalise_text(c: Column) -> Column:
    """Comparison key of a cue's text."""
    return without_punctuation(fold(strip(c)))


def normalise_query(c: Column) -> Column:
    """Comparison key of a search query: neither stripped nor squeezed."""
    return fold(without_punctuation(c))


def merge_bilingual(original: Column, english: Column) -> Column:
    """Both texts in two lines, or the original alone if they are the same but for case, blanks at the ends and punctuation."""
    o, e = strip(original), strip(english)
    return F.when(without_punctuation(fold(o)) == without_punctuation(fold(e)), o).otherwise(F.concat(o, F.lit("\n"), e))


def newlines(c: Column) -> Column:
    """Literal escapes, CRLF and CR as LF, in this order."""
    for a, b in (("\\r", "\r"), ("\\n", "\n"), ("\r\n", "\n"), ("\r", "\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def parentheses(c: Column) -> Column:
    """Braces as parentheses: subtitle players take braces for style codes."""
    return F.translate(c, "{}", "()")
