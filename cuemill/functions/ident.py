"""Identifiers: short codes of models, display names, content hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tiers of the model family with an own code, in the order in which they are tried.
TIERS = (("flash-lite", "l"), ("lite", "l"), ("flash", "f"), ("pro", "p"))
FAMILY, FAMILY_CODE, VARIANTS = "gemini", "g", {"preview": "p"}
MANAGED_NAME = r"^part_\d{3}\.[^./]+\n?$"


def _file_safe(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("."), F.lit("")), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used; keeps the generated code small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _behind(c: Column, n: int | Column) -> Column:
    """What is left behind the first ``n`` characters, without leading separators."""
    return F.regexp_replace(F.substring(c, F.lit(n) + 1 if isinstance(n, int) else n + 1, F.length(c)), "^[-_]+", "")


def _tiered(tail: Column, base: Column) -> Column:
    tier = F.lit(FAMILY_CODE)
    word = F.lit("")
    for name, code in reversed(TIERS):
        hit = tail.rlike(f"^{name}(?:[-_]|$)")
        tier, word = F.when(hit, code).otherwise(tier), F.when(hit, name).otherwise(word)
    variant = F.when(word == "", tail).otherwise(_behind(tail, F.length(word)))
    return F.struct(F.concat(base, tier).alias("base"), variant.alias("variant"))


def _family(name: Column) -> Column:
    def versioned(rest: Column) -> Column:
        version = F.regexp_extract(rest, r"(\d+(?:\.\d+)*)", 1)
        tail = F.when(rest.rlike(r"\d"), F.regexp_replace(F.regexp_replace(rest, r"^(\D*)\d+(?:\.\d+)*", "$1"), "^[-_]+", "")).otherwise(rest)
        return F.struct(F.concat(F.lit(FAMILY_CODE), F.replace(version, F.lit("."), F.lit(""))).alias("base"), tail.alias("tail"))

    def spelt(x: Column) -> Column:
        suffix = _file_safe(x["variant"])
        out = F.when(suffix == "", x["base"]).otherwise(F.concat(x["base"], F.lit("-"), suffix))
        for word, code in VARIANTS.items():
            out = F.when(x["variant"] == word, F.concat(x["base"], F.lit(code))).otherwise(out)
        return out

    return _let(_behind(name, len(FAMILY)), lambda rest: _let(versioned(rest), lambda v: _let(_tiered(v["tail"], v["base"]), spelt)))


def model_shortcode(model: Column) -> Column:
    """Of the known family ``g<version><tier><variant>``, of any other model its name made safe for files."""
    name = F.lower(F.regexp_replace(model, "^[^:]*:", ""))
    other = _let(_file_safe(name), lambda s: F.when(s == "", "model").otherwise(s))
    return F.when(F.startswith(name, F.lit(FAMILY)), _family(name)).otherwise(other)


def lyrics_tag(model: Column, lyrics_version: int) -> Column:
    return F.format_string("%s-%02d", model_shortcode(model), F.lit(lyrics_version))


def subtitles_tag(model: Column, lyrics_version: int, subtitles_version: int) -> Column:
    return F.format_string("%s-%02d%02d", model_shortcode(model), F.lit(lyrics_version), F.lit(subtitles_version))


def is_google(model: Column) -> Column:
    """Whether a model is called through the provider's own interface; the prefix is a fixed value."""
    return F.startswith(F.lower(model), F.lit("google-gla"))


def sha256_hex(content: Column) -> Column:
    """The content's hash as lower-case hexadecimal digits."""
    return F.sha2(content, 256)


def is_managed(display_name: Column) -> Column:
    """Whether the last part of the name is ``part_NNN.ext``; null counts as no."""
    return F.coalesce(F.substring_index(display_name, "/", -1).rlike(MANAGED_NAME), F.lit(False))


def unique_display_name(path: Column) -> Column:
    """``folder/file``; a folder named ``reencoded`` is passed over."""
    parts = F.split(path, "/")
    folder = F.try_element_at(parts, F.lit(-2))
    folder = F.when(folder == "reencoded", F.try_element_at(parts, F.lit(-3))).otherwise(folder)
    return F.concat(F.coalesce(folder, F.lit("")), F.lit("/"), F.element_at(parts, -1))


def _base64(c: Column) -> Column:
    return F.regexp_replace(F.base64(c), "[\r\n]", "")


def hashes_match(remote: Column, local_hex: Column) -> Column:
    """Hex in any case, Base64 of the hex digits or Base64 of the digest; null or empty matches nothing."""
    hit = (
        (F.lower(remote) == F.lower(local_hex))
        | (remote == _base64(local_hex.cast("binary")))
        | (remote == _base64(F.try_to_binary(local_hex, F.lit("hex"))))
        | (F.lower(F.try_to_binary(remote, F.lit("base64")).cast("string")) == F.lower(local_hex))
    )
    return F.coalesce(hit & (remote != ""), F.lit(False))


def hash_key(remote: Column) -> Column:
    """Lower-case hex of a hash in any of the spellings, so that equal hashes can be joined; null if it is none."""
    raw = F.try_to_binary(remote, F.lit("base64"))
    text = F.lower(F.when(F.length(raw) == 64, F.decode(raw, "UTF-8")))
    return F.when(remote.rlike("^[0-9a-fA-F]{64}$"), F.lower(remote)).when(text.rlike("^[0-9a-f]{64}$"), text).when(F.length(raw) == 32, F.lower(F.hex(raw)))
