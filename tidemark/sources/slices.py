"""Time slices as trees of folders: written by hour, minute and second, read with the folders that a filter leaves, and merged where their files drift."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = ("hour", "minute", "second")
_PARTS = {"hour": F.hour, "minute": F.minute, "second": F.second}


def write_slices(rows: DataFrame, path: str, ts: str, levels: Sequence[str] = LEVELS) -> None:
    """rows as Parquet under hour=/minute=/second= of a timestamp, each folder by one task and sorted by time.

    With fewer levels (a second's rows may be few) a file's row groups still tell the times that they hold apart.
    """
    parts = rows.withColumns({n: _PARTS[n](ts) for n in levels})
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, else small tables would be written by one task, folder by folder
    parts.repartition(tasks, *levels).sortWithinPartitions(*levels, ts).write.partitionBy(*levels).parquet(path)


def read_slices(spark: SparkSession, path: str, where: Column, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of a tree of write_slices() whose hour, minute and second satisfy a condition; folders that don't are never read."""
    read = spark.read.schema(schema) if schema else spark.read
    return read.parquet(path).where(where)


def read_tree(spark: SparkSession, path: str, name: str, hour: int | None = None, minute: int | None = None) -> DataFrame:
    """The files `name` of a tree <hour>/<minute>/<second>/name, whose folders carry no keys, with hour, minute and second from their paths.

    Only folders of the given hour and minute are listed. A tree without such files is an error, as for any path without files.
    """
    level = lambda n: "*" if n is None else f"{{{n},{n:02d}}}"
    rows = spark.read.parquet(f"{path}/{level(hour)}/{level(minute)}/*/{name}")
    part = lambda i: F.element_at(F.split("_metadata.file_path", "/"), F.lit(i)).cast("int")
    return rows.withColumns({"hour": part(-4), "minute": part(-3), "second": part(-2)})


#: Numbers from the narrowest on; each one's values are values of those after it, but for long and float, which meet in double.
_WHOLE, _REAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)


def supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds both: wider numbers, fields of both structs, elements' supertype; text where nothing else does."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        theirs = {f.name: f.dataType for f in b}
        own = [T.StructField(f.name, supertype(f.dataType, theirs[f.name]) if f.name in theirs else f.dataType) for f in a]
        return T.StructType([*own, *(T.StructField(f.name, f.dataType) for f in b if f.name not in a.names)])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(supertype(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(supertype(a.keyType, b.keyType), supertype(a.valueType, b.valueType))
    for narrow, wide in ((a, b), (b, a)):
        if isinstance(narrow, _WHOLE) and isinstance(wide, _WHOLE):
            return max(a, b, key=lambda t: _WHOLE.index(type(t)))
        if isinstance(narrow, (*_WHOLE, *_REAL)) and isinstance(wide, _REAL):
            return T.DoubleType()
        if isinstance(narrow, T.DecimalType) and isinstance(wide, T.DecimalType):
            whole, scale = max(a.precision - a.scale, b.precision - b.scale), max(a.scale, b.scale)
            return T.DecimalType(min(38, whole + scale), scale) if whole + scale <= 38 else T.DoubleType()
        if isinstance(narrow, T.DecimalType) and isinstance(wide, (*_WHOLE, *_REAL)):
            return T.DoubleType()
        if isinstance(narrow, T.DateType) and isinstance(wide, (T.TimestampType, T.TimestampNTZType)):
            return wide
        if isinstance(narrow, T.TimestampNTZType) and isinstance(wide, T.TimestampType):
            return wide
    return T.StringType()


def widened(x: Column, have: T.DataType, want: T.DataType) -> Column:
    """A column as a supertype; fields that it lacks are null, nested values that become text are JSON."""
    if have == want:
        return x
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        fields = [(widened(x[f.name], have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(x.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(x, lambda e: widened(e, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        keys = F.transform(F.map_keys(x), lambda e: widened(e, have.keyType, want.keyType))
        return F.map_from_arrays(keys, F.transform(F.map_values(x), lambda e: widened(e, have.valueType, want.valueType)))
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(x)
    return x.cast(want)


def nullable(t: T.DataType) -> T.DataType:
    """A type in which every value may be missing, so that types compare by what they hold."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(nullable(t.elementType))
    return T.MapType(nullable(t.keyType), nullable(t.valueType)) if isinstance(t, T.MapType) else t


def merge_slices(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All rows of slices whose columns and types differ, under one schema: columns of any slice, in the order met, as their supertype.

    A slice's schema is that of one of its files (one footer is read for each slice). Slices of one schema are read together,
    so the union has a branch for each distinct schema.
    """
    alike: dict[str, tuple[T.StructType, list[str]]] = {}
    with ThreadPoolExecutor(16) as pool:  # short jobs, side by side
        schemas = [*pool.map(inheritable_thread_target(spark)(lambda p: nullable(spark.read.parquet(p).schema)), paths)]
    for p, schema in zip(paths, schemas):
        alike.setdefault(schema.json(), (schema, []))[1].append(p)
    whole: T.DataType = T.StructType([])
    for schema, _ in alike.values():
        whole = supertype(whole, schema)
    out = None
    for schema, same in alike.values():
        rows = spark.read.schema(schema).parquet(*same)
        part = rows.select(*[(widened(rows[f.name], schema[f.name].dataType, f.dataType) if f.name in schema.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in whole])
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no slices")
    return out
