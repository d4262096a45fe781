"""Columns of the state that a page's script holds as JSON between two markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands before and after the state in a page.
START, END = '"webapp.video-detail":', ',"webapp.a-b":'
NO_STATE, BROKEN, NO_ITEM = "no state", "broken state", "no item"


def between(text: Column, start: str = START, end: str = END) -> Column:
    """What stands between the first `start` and the first `end` after it; null if one of them is missing."""
    rest = F.substring(text, F.locate(start, text) + len(start), F.length(text))
    return F.when((F.locate(start, text) > 0) & (F.locate(end, rest) > 0), F.substring(rest, F.lit(1), F.locate(end, rest) - 1))


def state(html: Column, item: str, start: str = START, end: str = END) -> Column:
    """struct(item, status_code, status_msg, error): a page's item by a schema (DDL of fields), or the status it was answered with, or what is wrong with it.

    A status of 0 or none is a success, and needs an item.
    """
    schema = f"statusCode bigint, statusMsg string, itemInfo struct<itemStruct: struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in item.split(','))}>>, _corrupt string"
    text = between(html, start, end)
    told = F.from_json(text, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    failed = F.coalesce(told["statusCode"], F.lit(0)) != 0
    found = told["itemInfo"]["itemStruct"]
    error = F.when(text.isNull(), NO_STATE).when(told.isNull() | told["_corrupt"].isNotNull(), BROKEN).when(~failed & found.isNull(), NO_ITEM)
    good = error.isNull() & ~failed
    return F.struct(F.when(good, found).alias("item"), F.when(failed & error.isNull(), told["statusCode"]).alias("status_code"),
                    F.when(failed & error.isNull(), told["statusMsg"]).alias("status_msg"), error.alias("error"))
