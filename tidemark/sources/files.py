"""JSON and CSV files as DataFrames, and sinks that are read back."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMENTS = "data struct<comments: array<struct<cid: bigint, text: string, user: struct<uid: bigint, follower_count: bigint, following_count: bigint>>>>"
CORRUPT = "_corrupt"
#: Bytes up to which a JSON file is read as one row.
WHOLE = 8_000_000


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins and the last ends; null is empty."""
    array = column.cast(pa.large_string()).fill_null("")
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    _, where, data = array.buffers()
    offsets = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which driver and executors share."""
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def parsed(text: Column, schema: str) -> Column:
    """A JSON text by a schema (DDL of fields), with the text in CORRUPT where it isn't well-formed."""
    return F.from_json(text, f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})


def _object(line: Column, schema: str) -> Column:
    """Whether a line is a whole JSON object by itself."""
    t = F.trim(line)
    return t.startswith("{") & t.endswith("}") & parsed(t, schema)[CORRUPT].isNull()


def read_json_files(spark: SparkSession, path: str, schema: str, whole: int = WHOLE) -> DataFrame:
    """file, doc: one row a JSON document of files that hold one document, over many lines, or one in each line.

    A file whose first or last line is a whole object holds one in each line, any other one document, unless it
    isn't well-formed: then each line stands for itself again. What isn't well-formed has its text in doc's CORRUPT, so
    no line takes others with it. Files up to `whole` bytes, answers that were fetched, are rows. Larger ones are read by line, in as many
    tasks as they have blocks; only where such a file turns out to be one document is it read in one piece, and only the names of those come to the driver.
    """
    file = F.col("_metadata.file_path").alias("file")
    size = F.col("_metadata.file_size")
    text = spark.read.text(path, wholetext=True)

    def documents(files: DataFrame) -> DataFrame:
        lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
        one = parsed(F.col("value"), schema)
        ends = [F.coalesce(_object(F.try_element_at("lines", F.lit(i)), schema), F.lit(False)) for i in (1, -1)]
        by_line = ends[0] | ends[1] | (F.col("one")[CORRUPT].isNotNull() & (F.size("lines") > 1))
        docs = F.when(by_line, F.transform("lines", lambda x: parsed(x, schema))).when(F.size("lines") > 0, F.array("one"))
        return files.select("file", "value", lines.alias("lines"), one.alias("one")).select("file", F.explode(docs).alias("doc"))

    small = documents(text.where(size <= whole).select(file, "value"))
    lines = spark.read.text(path).where((size > whole) & (F.trim("value") != "")).select(
        file, "value", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    ends = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"), F.max_by("value", "at").alias("tail"))
    told = ends.select("file", (_object(F.col("head"), schema) | _object(F.col("tail"), schema)).alias("by_line"))
    single = [r["file"] for r in told.where("not by_line").select("file").collect()]  # names of files over `whole` bytes that are one document, or broken
    large = lines.where(~F.col("file").isin(single)) if single else lines
    out = small.unionByName(large.select("file", parsed(F.col("value"), schema).alias("doc")))
    if not single:
        return out
    return out.unionByName(documents(text.where(F.col("_metadata.file_path").isin(single)).select(file, "value")))


def read_json_documents(spark: SparkSession, path: str, schema: str, whole: int = WHOLE) -> DataFrame:
    """doc of read_json_files() where it is well-formed."""
    return read_json_files(spark, path, schema, whole).where(F.col(f"doc.{CORRUPT}").isNull()).select("doc")


def quarantined(rows: DataFrame) -> DataFrame:
    """file and text of what isn't well-formed."""
    return rows.where(F.col(f"doc.{CORRUPT}").isNotNull()).select("file", F.col(f"doc.{CORRUPT}").alias("text"))


def comments(docs: DataFrame) -> DataFrame:
    """cid, text and the fields of user; documents without data.comments have none."""
    return docs.select(F.explode("doc.data.comments").alias("c")).select("c.cid", "c.text", "c.user.*")


def cut_records(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each object at the head of a JSON array in texts whose bytes lie one after another.

    One pass each tells which bytes a backslash escapes, which lie in strings and how deep brackets nest; every count begins anew
    with each text. A text's records end at the first byte between them that is neither white space nor a comma.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n)
    full = offsets[:-1] < offsets[1:]
    heads = offsets[:-1][full]
    row = np.repeat(np.flatnonzero(full), np.diff(offsets)[full])

    def within(counts: np.ndarray) -> np.ndarray:
        """A running count that begins at 0 in each text."""
        return counts - np.repeat(np.append(0, counts)[heads], np.diff(offsets)[full])

    slash = data == ord("\\")
    other = np.where(slash, -1, at)
    other[heads] = np.where(slash[heads], heads - 1, heads)
    run = at - np.maximum.accumulate(other)  # backslashes that end here
    escaped = np.zeros(n, bool)
    escaped[1:] = run[:-1] % 2 == 1
    escaped[heads] = False
    quote = (data == ord('"')) & ~escaped
    outside = (within(np.cumsum(quote)) % 2 == 0) & ~quote
    opens = outside & ((data == ord("{")) | (data == ord("[")))
    closes = outside & ((data == ord("}")) | (data == ord("]")))
    depth = within(np.cumsum(opens.astype(np.int64) - closes))
    first = opens & (depth == 2) & (data == ord("{"))
    last = closes & (depth == 1) & (data == ord("}"))
    # What may stand at depth 1: the array's own bracket at the head of the text, white space, commas and the ends of records.
    fine = (depth > 1) | last | np.isin(data, list(b" \t\r\n,"))
    fine[heads] = data[heads] == ord("[")
    fine &= ~(opens & (depth == 2) & ~first)
    good = within(np.cumsum(~fine)) == 0
    start, end = np.flatnonzero(first & good), np.flatnonzero(last & good)
    # A text's last record may be cut off, so it has one start more than it has ends.
    begun = within(np.cumsum(first & good))[end] - 1
    return row[end], start[np.searchsorted(row[start], row[end]) + begun], end + 1


def salvage(docs: DataFrame, text: str, schema: str) -> DataFrame:
    """docs' other columns, record (by the schema, with CORRUPT) of each whole record at the head of a JSON array that may be cut off."""

    @F.arrow_udf("array<string>")
    def heads(column: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        row, start, end = cut_records(data, offsets)
        counts = np.cumsum(np.append(0, np.bincount(row, minlength=len(column))))
        raw = data.tobytes()
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary()).cast(pa.string()))

    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.explode(heads(text)).alias("_t")).select(*rest, parsed(F.col("_t"), schema).alias("record"))


def read_csv_preamble(spark: SparkSession, path: str, schema: StructType | str, skip: int) -> DataFrame:
    """CSV of a dimension, after `skip` lines of each file that aren't data (its header among them); files are read whole."""
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where((F.col("n") >= skip) & (F.col("line") != ""))
    return lines.select(F.from_csv("line", schema, {"escape": '"'}).alias("r")).select("r.*")


def write_sidecars(rows: DataFrame, name: Column, path: str, each: int = 50) -> None:
    """A JSON file in a folder of its own for each name. A file costs its opening and not its bytes, so tasks get `each` rows and move their own files."""
    parts = max(1, math.ceil(rows.count() / each))
    named = rows.withColumn("name", name).repartition(parts, "name")
    named.write.partitionBy("name").option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)


def read_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON files with `at`, the timestamp of ten digits and a fraction in a file's path; files without one are an error.

    Folders are only names here: as keys the driver would read and compare each one's value.
    """
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(path).withColumn("_at", F.regexp_extract(F.col("_metadata.file_path"), r"\d{10}\.\d{0,6}", 0))
    at = F.when(F.col("_at") != "", F.col("_at").cast("double")).otherwise(F.raise_error(F.lit("a file without a timestamp")).cast("double"))
    return rows.withColumn("at", at).drop("_at")


def resolve_listing(rows: DataFrame, folders: list[str], name: Column, listing: DataFrame) -> DataFrame:
    """rows with each path folder + name that a listing (path) holds."""
    candidates = rows.withColumn("path", F.explode(F.transform(F.array(*map(F.lit, folders)), lambda d: F.concat(d, name))))
    return candidates.join(listing.select("path"), "path", "left_semi")


def sink_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def sink_partitioned_csv(df: DataFrame, path: str, key: str) -> None:
    """A folder of CSV files for each value of the key, in one pass."""
    df.write.partitionBy(key).option("header", True).csv(path)
