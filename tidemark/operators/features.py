"""Sparse features of posts: a vocabulary learned from all rows, vectors, column sums, pruning, moments of pairs, and regression on them.

A matrix is a DataFrame with a row a key: `indices` and `values` of what isn't zero, by rising index; rows without features stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRIES = "indices", "values"


def vocabulary(rows: DataFrame, items: str, least: int = 1) -> DataFrame:
    """feature, idx, n, rows: items of an array column that occur over `least` times, numbered from 0 by falling n, then by name.

    The ranks are those of a table of at most 1/least of all items; it is numbered in one task.
    """
    own = F.transform(F.array_distinct(items), lambda x: F.struct(x.alias("feature"), F.size(F.filter(items, lambda y: y == x)).alias("_n")))
    n = rows.select(F.inline(own)).groupBy("feature").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("rows")).where(F.col("n") > least)
    return n.withColumn("idx", (F.row_number().over(Window.orderBy(F.desc("n"), "feature")) - 1).cast("int"))


def matrix(rows: DataFrame, key: str, items: str, vocab: DataFrame) -> DataFrame:
    """key, indices, values: how often each row has each feature of the vocabulary. Rows of one key add up."""
    flat = rows.select(key, F.explode_outer(items).alias("feature")).join(vocab.select("feature", "idx"), "feature", "left")
    cells = flat.groupBy(key, "idx").agg(F.count(F.lit(1)).cast("double").alias("x"))
    held = F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "x"))))
    return cells.groupBy(key).agg(held.alias("_e")).select(key, F.col("_e.idx").alias("indices"), F.col("_e.x").alias("values"))


def column_sums(m: DataFrame) -> DataFrame:
    """idx, total, squares of every column that isn't all zero, in one aggregate."""
    cells = m.select(F.inline(F.arrays_zip(*ENTRIES)))
    return cells.groupBy(F.col("indices").alias("idx")).agg(F.sum("values").alias("total"), F.sum(F.col("values") * F.col("values")).alias("squares"))


def prune(m: DataFrame, vocab: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The matrix and the vocabulary without columns whose sum is under `least`, numbered anew in the same order."""
    kept = vocab.join(column_sums(m).where(F.col("total") >= least).select("idx", "total"), "idx")
    kept = kept.withColumn("_new", (F.row_number().over(Window.orderBy("idx")) - 1).cast("int"))  # a row a feature
    key = [c for c in m.columns if c not in ENTRIES]
    cells = m.select(*key, F.explode_outer(F.arrays_zip(*ENTRIES)).alias("_e")).select(*key, F.col("_e.indices").alias("idx"), F.col("_e.values").alias("x"))
    moved = cells.join(kept.select("idx", "_new"), "idx", "left")
    held = F.array_sort(F.collect_list(F.when(F.col("_new").isNotNull(), F.struct("_new", "x"))))
    left = moved.groupBy(*key).agg(held.alias("_e")).select(*key, F.col("_e._new").alias("indices"), F.col("_e.x").alias("values"))
    return left, kept.drop("idx").withColumnRenamed("_new", "idx")


#: Pairs that a task holds at a time.
PAIRS = 2_000_000


def moments(m: DataFrame) -> DataFrame:
    """i, j (i <= j) and dot: the sum of products of every two columns that some row holds together, by one pass over the rows' own pairs.

    A batch's pairs are added up in its task, so what is shuffled is a row a pair of columns and PAIRS pairs, not one a pair and row.
    """

    def added(batches):
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch["indices"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            index, x = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ENTRIES)
            ends = np.repeat(np.cumsum(lengths), lengths)
            partners = ends - np.arange(len(index))  # an entry's own row from it on
            cuts = np.append(0, np.cumsum(partners))
            start = 0
            while start < len(index):
                stop = max(start + 1, int(np.searchsorted(cuts, cuts[start] + PAIRS, "right")) - 1)
                n = partners[start:stop]
                a = np.repeat(np.arange(start, stop), n)
                b = a + np.arange(len(a)) - np.repeat(cuts[start:stop] - cuts[start], n)
                key, at = np.unique(index[a].astype(np.int64) << 32 | index[b], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(np.bincount(at, x[a] * x[b], len(key)))], ["i", "j", "p"])
                start = stop

    held = m.select(F.col("indices").cast("array<int>").alias("indices"), F.col("values").cast("array<double>").alias("values"))
    return held.mapInArrow(added, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("dot"))


def correlated(m: DataFrame, above: float = 0.8) -> DataFrame:
    """i, j (i < j) and r of columns whose correlation over all rows lies above `above` in size.

    Columns that no row holds together are correlated, too: the more negatively the fuller they are. Only those whose own fullness
    leaves room for it are set against each other.
    """
    sums = column_sums(m).withColumn("n", F.lit(m.count()).cast("double"))
    variance = F.col("n") * F.col("squares") - F.col("total") * F.col("total")
    columns = sums.where(variance > 0).select("idx", "total", "n", variance.alias("v")).withColumn("fullness", F.col("total") * F.col("total") / F.col("v"))
    a, b = (columns.select(*[F.col(c).alias(f"{c}_{s}") for c in columns.columns]) for s in "ab")
    fullest = columns.agg(F.max("fullness").alias("most"))
    full = columns.join(F.broadcast(fullest), F.col("fullness") * F.col("most") > above * above).select("idx")
    apart = full.select(F.col("idx").alias("i")).join(full.select(F.col("idx").alias("j")), F.col("i") < F.col("j")).withColumn("dot", F.lit(0.0))
    both = moments(m).where("i < j").unionByName(apart).groupBy("i", "j").agg(F.sum("dot").alias("dot"))
    r = (F.col("n_a") * F.col("dot") - F.col("total_a") * F.col("total_b")) / F.sqrt(F.col("v_a") * F.col("v_b"))
    return both.join(a, F.col("i") == F.col("idx_a")).join(b, F.col("j") == F.col("idx_b")).select("i", "j", r.alias("r")).where(F.abs("r") > above)


def with_dense(m: DataFrame, dense: dict[str, Column]) -> DataFrame:
    """The matrix with dense columns in front of its own, whose numbers grow by as many."""
    n = len(dense)
    own = [F.struct(F.lit(i).alias("i"), x.cast("double").alias("x")) for i, x in enumerate(dense.values())]
    e = F.concat(F.array(*own), F.transform(F.arrays_zip(*ENTRIES), lambda c: F.struct((c["indices"] + n).alias("i"), c["values"].alias("x"))))
    rest = [c for c in m.columns if c not in ENTRIES]
    return m.select(*rest, e.alias("_e")).select(*rest, F.col("_e.i").alias("indices"), F.col("_e.x").alias("values"))


def least_squares(m: DataFrame, y: str, features: int, most: int = 4000) -> tuple[np.ndarray, float, float]:
    """Coefficients of columns 0 to features - 1, the intercept and r2 of y; of all best solutions the shortest, so linear dependence does no harm.

    Spark sums products of pairs; the driver solves a system of `features` + 1, at most `most`.
    """
    if features > most:
        raise ValueError(f"{features} features are too many for normal equations; prune them")
    rows = with_dense(m.where(F.col(y).isNotNull()), {"one": F.lit(1.0), "y": F.col(y)})
    k = features + 2
    gram = np.zeros((k, k))
    for i, j, dot in moments(rows).collect():  # at most k * k numbers
        gram[i, j] = gram[j, i] = dot
    if not gram[0, 0]:
        raise ValueError("no rows")
    n, mean = gram[0, 0], gram[0] / gram[0, 0]
    centred = gram - n * np.outer(mean, mean)
    x, own = np.arange(2, k), centred[2:, 2:]
    scale = np.sqrt(np.clip(np.diag(own), 0, None))
    scale[scale < 1e-9 * np.sqrt(n)] = 0
    unit = np.divide(1, scale, out=np.zeros_like(scale), where=scale > 0)
    b = np.linalg.pinv(own * np.outer(unit, unit), rcond=1e-9, hermitian=True) @ (centred[2:, 1] * unit) * unit
    explained = b @ own @ b
    return b, float(mean[1] - b @ mean[x]), float(explained / centred[1, 1]) if centred[1, 1] > 0 else 0.0
