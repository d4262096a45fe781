"""Columns of a request's attempts, which logs hold as the text of a list of dictionaries in Python's notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How Python writes texts, times and dictionaries of these keys. No part of a text can be read in two ways, so none is tried again.
TEXT = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|None"""
TIME = r"datetime\.datetime\([0-9, ]*\)|None"
ENTRY = rf"(?s)\{{'exception': ({TEXT}), 'pre_time': ({TIME}), 'post_time': ({TIME})\}}"
#: The longest message that is kept.
CUT = 100


def text(literal: Column) -> Column:
    """The text that a literal stands for; null for None. One with escapes is read as JSON, into which they are turned first."""
    odd = r"(?<!\\)((?:\\\\)*)\\"  # a backslash that isn't escaped itself
    body = F.substring(literal, F.lit(2), F.length(literal) - 2)
    plain = F.regexp_replace(body, '"', '\\\\"')
    plain = F.when(literal.startswith('"'), F.regexp_replace(body, odd + '"', '$1\\\\"')).otherwise(plain)
    plain = F.regexp_replace(plain, odd + "'", "$1'")
    plain = F.regexp_replace(plain, odd + "x([0-9a-fA-F]{2})", r"$1\\u00$2")
    read = F.get(F.from_json(F.concat(F.lit('["'), plain, F.lit('"]')), "array<string>"), F.lit(0))
    return F.when(literal == "None", F.lit(None)).when(literal.contains("\\"), read).otherwise(body)


def time(literal: Column) -> Column:
    """A time of day without a zone; null for None. Python leaves out seconds and their millionths where they are 0."""
    n = F.transform(F.regexp_extract_all(literal, F.lit(r"[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    part = lambda n, i: F.coalesce(F.get(n, F.lit(i)), F.lit(0))
    second = lambda n: (part(n, 5) + part(n, 6) / F.lit(1_000_000)).cast("decimal(16,6)")
    read = F.transform(F.array(n), lambda n: F.make_timestamp_ntz(*[part(n, i) for i in range(5)], second(n)))  # the numbers are found once, not for each part
    return F.when(literal != "None", F.get(read, F.lit(0)))


def parse(log: Column) -> Column:
    """array<struct<exception, pre_time, post_time>> of a log's entries, in order; what isn't an entry between them is passed over, null gives null."""
    found = [F.regexp_extract_all(log, F.lit(ENTRY), F.lit(i)) for i in (1, 2, 3)]
    rows = F.arrays_zip(*[f.alias(n) for f, n in zip(found, ("e", "pre", "post"))])
    return F.transform(rows, lambda r: F.struct(text(r["e"]).alias("exception"), time(r["pre"]).alias("pre_time"), time(r["post"]).alias("post_time")))


def truncate(parsed: Column, cut: int = CUT) -> Column:
    """The attempts with messages of `cut` characters at most."""
    return F.transform(parsed, lambda a: a.withField("exception", F.substring(a["exception"], 1, cut)))
