"""Columns for status, text and number rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How answers call a missing item and an id that can't be one.
GONE = "item doesn't exist"
INVALID, INVALID_CODE = "invalid item id", 100002


def success(status: Column, post_id: Column) -> Column:
    """Kleene OR: null for an answer with neither status nor id."""
    return (status != GONE) | post_id.isNotNull()


def maybe_existed(code: Column, status: Column, post_id: Column) -> Column:
    """Whether an answer leaves room for a post: not for no answer, a missing item or an invalid id."""
    none = code.isNull() & status.isNull() & post_id.isNull()
    missing = code.isin(10204, 10222) & (status == GONE)
    return ~(none | F.coalesce(missing, F.lit(False)) | invalid_id(code, status))


def invalid_id(code: Column, status: Column) -> Column:
    """Whether an answer says that the id can't be one; not for no answer."""
    return F.coalesce((code == INVALID_CODE) & (status == INVALID), F.lit(False))


#: What counts as a hashtag in ASCII and in Unicode.
ASCII_TAG, UNICODE_TAG = "#[a-zA-Z0-9_]+", r"(?U)#\w+"


def hashtags(text: Column, unicode: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(UNICODE_TAG if unicode else ASCII_TAG), F.lit(0))


def zero_if_missing(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def path_stem(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def human_count(n: Column) -> Column:
    """1.2m, 3.4k or the number itself."""
    return (F.when(n >= 1_000_000, F.concat(F.format_number(n / 1_000_000, 1), F.lit("m")))
            .when(n >= 1_000, F.concat(F.format_number(n / 1_000, 1), F.lit("k"))).otherwise(n.cast("string")))


def shortened(text: Column, most: int = 20) -> Column:
    """The first characters of longer texts, and three dots."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
