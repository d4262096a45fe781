"""Species probabilities, bootstrap intervals, permutation tests and curve fits from aggregates."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import shuffles_dropped


def N():
    return F.count(F.lit(1))


def good_turing(cc: DataFrame) -> DataFrame:
    """r, species -> r, species, p: the simple Good-Turing probability of a value seen r times (Gale and Sampson 1995).

    Z(r) averages counts over gaps, a line through ln Z and ln r smooths them, and Turing's own estimate
    holds up to the first r where it is missing or within 1.96 standard deviations of the smoothed one.
    One row a distinct count, so the windows are short (at most the root of twice the observations).
    """
    w = Window.orderBy("r")
    r, n = F.col("r"), F.col("species")
    low, high = F.coalesce(F.lag("r").over(w), F.lit(0)), F.lead("r").over(w)
    z = cc.withColumn("z", n / (F.coalesce(high, 2 * r - low) - low) * 2).withColumn("n1", F.when(high == r + 1, F.lead("species").over(w)))
    line = z.agg(F.regr_slope(F.ln("z"), F.ln("r")).alias("b"), F.sum(r * n).alias("total"), F.coalesce(F.sum(F.when(r == 1, n)), F.lit(0)).alias("once"))
    x = (r + 1) * F.col("n1") / n
    y = (r + 1) * F.pow((r + 1) / r, F.coalesce("b", F.lit(-1.0)))
    sd = F.sqrt(F.pow(r + 1, 2) * F.col("n1") / (n * n) * (1 + F.col("n1") / n))
    rows = z.crossJoin(F.broadcast(line)).withColumn("x", x).withColumn("y", y).withColumn("smooth", F.coalesce(F.abs(x - y) <= 1.96 * sd, F.lit(True)))
    past = F.max(F.col("smooth").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("star", F.when(past == 1, F.col("y")).otherwise(F.col("x")))
    scale = F.sum(F.col("star") * n).over(Window.partitionBy("total"))
    return rows.select("r", "species", ((1 - F.col("once") / F.col("total")) * F.col("star") / scale).alias("p"))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys only: 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def distinct_interval(counts: DataFrame, key: str, x: str, replicates: int, level: float) -> DataFrame:
    """key, distinct and lower: of the distinct values of x and their one-sided percentile interval under a Poisson bootstrap.

    counts has n for each key and x. A value seen n times is in a replicate with 1 - exp(-n).
    """
    rows = counts.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    there = uniform(F.col(key), F.col(x), F.col("rep")) < 1 - F.exp(-F.col("n").cast("double"))
    each = rows.groupBy(key, "rep").agg(F.count_if(there).alias("d"))
    lower = each.groupBy(key).agg(F.percentile("d", F.lit(1 - level)).alias("lower"))
    return counts.groupBy(key).agg(N().alias("distinct")).join(lower, key)


def uniform_segments(words: DataFrame, word: str, bits: int, shortest: int, longest: int) -> DataFrame:
    """start, stop, sd: of the counts of every value, absent ones too, of bits start to stop of a word, counted from its highest.

    The longest segment from each start is counted once; shorter ones are its leading bits.
    """
    starts = F.sequence(F.lit(0), F.lit(bits - shortest - 1))
    rows = words.select(F.col(word).alias("_w"), F.explode(starts).alias("start"))
    most = F.least(F.lit(longest), F.lit(bits) - F.col("start"))
    top = rows.withColumn("most", most).withColumn("x", F.expr(f"shiftrightunsigned(_w, {bits} - start - most) & (shiftleft(1L, most) - 1)"))
    counted = top.groupBy("start", "most", "x").agg(N().alias("n"))
    each = counted.withColumn("len", F.explode(F.sequence(F.lit(shortest), F.col("most"))))
    shorter = each.groupBy("start", "len", F.expr("shiftrightunsigned(x, most - len)").alias("x")).agg(F.sum("n").alias("n"))
    size = F.pow(F.lit(2.0), F.col("len"))
    var = F.sum(F.col("n") * F.col("n")) / F.max(size) - F.pow(F.sum("n") / F.max(size), 2)
    return shorter.groupBy("start", "len").agg(F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd")).select("start", (F.col("start") + F.col("len")).alias("stop"), "sd")


#: Rows of a range that one task sorts, of all values of `by` together.
RANGE = 1_000_000


def numbered(rows: DataFrame, by: list[str], order: Column, ties: list[str]) -> DataFrame:
    """rows with i: the place from 0 in `by`, in the order of a hexadecimal string and tie breakers, sorted in ranges of it: 4096, or more for more rows than RANGE in each."""
    digits = max(3, math.ceil(math.log(max(1, rows.count() / RANGE), 16)))
    parts = rows.withColumn("_o", order).withColumn("_p", F.substring("_o", 1, digits))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    keys = [*by, "_p"]
    offsets = parts.groupBy(*keys).agg(N().alias("n")).select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(keys)], F.coalesce(before, F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by{i}")) for i, k in enumerate(keys)])
    place = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_o", *ties)) - 1
    ranked = parts.withColumn("_i", place).join(offsets, same)  # a row for each range and value of `by`; Spark broadcasts what is small
    return ranked.withColumn("i", F.col("_i") + F.col("_before")).drop("_o", "_p", "_i", "_before", *[f"_by{i}" for i in range(len(keys))])


#: Rows of a block of places that one task pairs, at least and at most; ranges of hashes a block; rows, counted for each replicate, that a
#: task packs at once; rows, counted so, that are dealt in one round.
BLOCK, MOST_BLOCK, RANGES, PACKED, ROUND = 1 << 16, 1 << 20, 32, 1 << 20, 1 << 25


def _words(hashes: pa.Array) -> np.ndarray:
    """Hashes of 16 bytes as two numbers each."""
    fixed = hashes.cast(pa.binary(16))
    return np.frombuffer(fixed.buffers()[1], ">u8")[fixed.offset * 2 :][: len(fixed) * 2].reshape(-1, 2).astype(np.uint64)


def _zipped(run: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, run.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(run)
    return out.getvalue().to_pybytes()


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many rows."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b] if b.num_rows else held, n + b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _dealt(held: DataFrame, n: int, key: str, keep: str, move: str, reps: list[int], distinct: bool = False) -> DataFrame:
    """rep, keep, move of the n rows of `held`: for each of reps the column `move` dealt anew; if distinct, equal rows of a block once.

    Both columns are put in orders of their own hashes and meet by place. Ranges of hashes are counted first, so it is known which
    blocks of places a range reaches; its rows go there at once, in compressed runs, are sorted in the block's task and paired with the other column's.
    The driver has 8 bytes for each range and column of a replicate. Rows of one hash are those of one key; their values rise,
    and nulls come last, of keys as of values.
    """
    block = min(max(BLOCK, n // 512), max(BLOCK, MOST_BLOCK))
    blocks = max(1, -(-n // block))
    bits = (blocks * RANGES).bit_length()
    ranges, shift, piece = 1 << bits, np.uint64(64 - bits), min(1 << bits, 4096)
    sides = [(rep, name) for rep in reps for name in ("a", "b")]
    hashes = [F.unhex(F.coalesce(F.md5(F.concat(F.lit(f"{name}:"), F.col(key).cast("string"), F.lit(f":{rep}"))), F.lit("f" * 32))).alias(f"{name}{rep}") for rep, name in sides]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(sides), ranges), np.int64)
        for b in batches:
            for i in range(len(sides) if b.num_rows else 0):
                sums[i] += np.bincount((_words(b.column(i))[:, 0] >> shift).astype(np.int64), minlength=ranges)
        pieces = sums.reshape(-1, piece)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array([x.tobytes() for x in pieces], pa.binary())], ["i", "n"])

    def added(i: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        return pa.table([pa.array([i[0].as_py()], pa.int32()), pa.array([sum(np.frombuffer(x, np.int64) for x in rows["n"].to_pylist()).tobytes()], pa.binary())], names=["i", "n"])

    counts = sorted(held.select(*hashes).mapInArrow(counted, "i int, n binary").groupBy("i").applyInArrow(added, "i int, n binary").collect())
    ends = np.frombuffer(b"".join(r["n"] for r in counts) or bytes(8 * len(sides) * ranges), np.int64).reshape(len(sides), ranges).cumsum(axis=1)
    places = np.arange(blocks) * block
    low = np.array([np.searchsorted(e, places, "right") for e in ends])  # the range with a block's first place
    high = np.array([np.searchsorted(e, np.minimum(places + block, n), "left") for e in ends])  # and that with its last
    begins = np.array([np.append(0, e)[at] for e, at in zip(ends, low)])  # the first place of the former
    least, most = low.astype(np.uint64) << shift, ((high.astype(np.uint64) + np.uint64(1)) << shift) - np.uint64(1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, PACKED // len(reps)):
            for i, (rep, name) in enumerate(sides):
                h, v = _words(rows[f"{name}{rep}"].chunk(0)), rows["_keep" if name == "a" else "_move"].chunk(0)
                order = np.argsort(h[:, 0])
                head, tail = h[order].T.copy()
                run = pa.RecordBatch.from_arrays([pa.array(head), pa.array(tail), v.take(pa.array(order))], ["head", "tail", "v"])
                start, stop = np.searchsorted(head, least[i], "left"), np.searchsorted(head, most[i], "right")
                to = np.flatnonzero(stop > start)
                runs = [_zipped(run.slice(start[k], stop[k] - start[k])) for k in to]
                yield pa.RecordBatch.from_arrays([pa.array(i // 2 * blocks + to, pa.int64()), pa.array(np.full(len(to), name == "b")), pa.array(runs, pa.binary())], ["_g", "_b", "run"])

    def placed(runs: pa.ChunkedArray, skip: int) -> pa.ChunkedArray:
        """The values of a block in order, of runs that begin so many places before it."""
        side = pa.concat_tables([pa.ipc.open_stream(r).read_all() for r in runs.to_pylist()]).combine_chunks()
        head = side["head"].to_numpy()
        order = np.argsort(head)
        if (np.diff(head[order]) == 0).any():
            order = pc.sort_indices(side, [(c, "ascending") for c in ("head", "tail", "v")], null_placement="at_end").to_numpy()
        return side["v"].take(pa.array(order[skip : skip + block]))

    def paired(g: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        i, at = divmod(g[0].as_py(), blocks)
        x, y = (placed(rows.filter(pc.equal(rows["_b"], k == 1))["run"], places[at] - begins[2 * i + k][at]) for k in (0, 1))
        out = pa.table([x, y], names=[keep, move])
        out = out.group_by([keep, move], use_threads=False).aggregate([]) if distinct else out
        return out.add_column(0, "rep", pa.array(np.full(len(out), reps[i], np.int32)))

    schema = StructType([StructField("rep", IntegerType()), held.schema[keep], held.schema[move]])
    runs = held.select(F.col(keep).alias("_keep"), F.col(move).alias("_move"), *hashes).mapInArrow(packed, "_g long, _b boolean, run binary")
    return runs.groupBy("_g").applyInArrow(paired, schema)


def shuffled(rows: DataFrame, key: str, keep: str, move: str, replicates: int) -> DataFrame:
    """rep, keep, move: for each replicate the column `move` dealt anew over the rows, so both columns' counts stay."""
    held = rows.select(key, keep, move).checkpoint()  # read for the counts and the deal
    return _dealt(held, held.count(), key, keep, move, list(range(1, replicates + 1)))


def group_sizes(rows: DataFrame, by: list[str], member: str, author: str) -> DataFrame:
    """by, size, groups: how many groups of so many members have one set of authors in common."""
    sets = rows.select(*by, member, author).distinct().groupBy(*by, member).agg(F.array_sort(F.collect_list(author)).alias("s"))
    size = sets.groupBy(*by, F.md5(F.array_join("s", ",")).alias("k")).agg(N().alias("size"))
    return size.groupBy(*by, "size").agg(N().alias("groups"))


def permutation_blocks(rows: DataFrame, key: str, member: str, author: str, replicates: int) -> DataFrame:
    """size, observed, mean, sd, p: groups of each observed size against replicates with authors dealt anew.

    The replicates are dealt in rounds of ROUND rows, one at least, and what a round has shuffled is dropped before the next, so the disk
    holds the rows and one round. The driver gets a row for each size, of which there are at most the root of twice the members.
    """
    spark, made = rows.sparkSession, []
    with shuffles_dropped(spark):
        held = rows.select(key, member, author).checkpoint()
        n = held.count()
        seen = group_sizes(held, [], member, author).collect()
        once = max(1, math.ceil(replicates / max(1, math.ceil(replicates * n / ROUND))))
        for first in range(1, replicates + 1, once):
            pairs = _dealt(held, n, key, member, author, list(range(first, min(first + once, replicates + 1))), distinct=True)
            made += group_sizes(pairs.repartition("rep", member), ["rep"], member, author).collect()
    made = spark.createDataFrame([tuple(r) for r in made], "rep int, size long, groups long")
    grid = spark.createDataFrame([tuple(r) for r in seen], "size long, observed long").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    both = grid.join(made, ["rep", "size"], "left").fillna(0, ["groups"])
    return both.groupBy("size", "observed").agg(F.avg("groups").alias("mean"), F.stddev_pop("groups").alias("sd"),
                                                F.avg((F.col("groups") >= F.col("observed")).cast("double")).alias("p"))


def _draws(key: str, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(key).encode())])


def prevalence(k, n, precision: float, recall: float):
    """Per cent of truly positive items where k of n were found positive; columns or numbers."""
    return k * precision / recall / n * 100


def prevalence_interval(groups: DataFrame, key: str, precision: float, recall: float, tested: int, replicates: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """key, k, n -> key, point, lower, upper in per cent; precision and recall vary as Beta with `tested` cases, k as a binomial."""

    def draw(batches):
        for rows in batches:
            out = []
            for g, k, n in zip(rows[key], rows["k"], rows["n"]):
                r = _draws(g, seed)
                p = r.beta(precision * tested, (1 - precision) * tested, replicates)
                q = r.beta(recall * tested, (1 - recall) * tested, replicates)
                made = r.binomial(n, k / n, replicates) * p / q / n * 100
                low, high = np.percentile(made, [(1 - level) / 2 * 100, (1 + level) / 2 * 100])
                out.append((g, prevalence(k, n, precision, recall), *np.clip([low, high], 0.0, 100.0)))
            yield pd.DataFrame(out, columns=[key, "point", "lower", "upper"])

    return groups.mapInPandas(draw, f"{key} string, point double, lower double, upper double")


#: The fewest cases a test set counts as, the trust from which on it is taken as unbiased, and how far bias may go at none.
FEWEST_CASES, UNBIASED, BIAS = 10.0, 0.9, 0.2


def prevalence_interval_adjusted(groups: DataFrame, key: str, precision: float, recall: float, tested: int, trust: float, level: float = 0.95,
                                 fewest: float = FEWEST_CASES, unbiased: float = UNBIASED, bias: float = BIAS) -> DataFrame:
    """key, k, n -> key, point, lower, upper in per cent, when the test set stands for the population only to the degree `trust`.

    The estimate k/n * precision/recall is a product of three independent proportions, so its logarithm is about
    normal and the relative variances add up: a proportion p of m cases has (1 - p) / (p m). By Kish's
    design effect a test set of trust t is worth tested * t**2 cases, `fewest` at least. Under the trust `unbiased` precision and recall
    may also be off as a whole, with a standard deviation of (1 - t) * bias. Where nothing was found (k = 0) the upper end
    is the exact binomial one of no success in n trials. A group without items has no interval.
    """
    tail = (1 - level) / 2
    z, cases = NormalDist().inv_cdf(1 - tail), max(fewest, tested * trust**2)
    off = (1 - trust) * bias if trust < unbiased else 0.0
    tested_part = sum((1 - p) / (p * cases) + (off / p) ** 2 for p in (precision, recall))
    k, n = F.col("k").cast("double"), F.when(F.col("n") > 0, F.col("n").cast("double"))
    point = prevalence(k, n, precision, recall)
    spread = F.exp(z * F.sqrt((1 - k / n) / k + tested_part))
    none = (1 - F.pow(F.lit(tail), 1 / n)) * (precision / recall * 100)
    upper = F.when(k == 0, none).otherwise(point * spread)
    lower = F.when((k == 0) & n.isNotNull(), F.lit(0.0)).otherwise(point / spread)
    return groups.select(key, point.alias("point"), lower.alias("lower"), F.least(upper, F.lit(100.0)).alias("upper"))


def robust_log_curve(t: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, levels: int = 12) -> tuple[float, float, float, float]:
    """a, c, d and the cost of rate = c * ln(t - a) + d under the soft-L1 loss 2 * (sqrt(1 + r**2) - 1) of weighted residuals r.

    For a given a the model is linear: least squares are repeated with each point's weight divided by sqrt(1 + r**2), which lowers
    the loss in every round. a lies under the first t; its distance from it is searched on a logarithmic grid that
    is refined around its best point, level by level.
    """

    def at(a: float) -> tuple[float, float, float, float]:
        x, w = np.column_stack([np.log(t - a), np.ones(len(t))]), weight.copy()
        for _ in range(rounds):
            fit = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
            r = weight * (y - x @ fit)
            after = weight / np.power(1 + r * r, 0.25)
            if np.allclose(after, w, rtol=1e-12, atol=0):
                break
            w = after
        return a, float(fit[0]), float(fit[1]), float(np.sum(np.sqrt(1 + r * r) - 1))

    low, high = np.log(1e-3), np.log(1e3 * max(1.0, float(np.ptp(t))))
    best = (0.0, 0.0, 0.0, np.inf)
    for _ in range(levels):
        grid = np.linspace(low, high, 25)
        found = [at(float(t.min() - np.exp(g))) for g in grid]
        k = int(np.argmin([f[3] for f in found]))
        best = min(best, found[k], key=lambda f: f[3])
        low, high = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    return best


def log_curves(series: DataFrame, by: str, t: str, rate: str, weight: str) -> DataFrame:
    """by, a, c, d, cost of each group's robust_log_curve; a series (a row a week) is in one task. Points with a null or no weight don't count; under three points there is no curve."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna().query("_weight > 0").sort_values(["_t", "_rate"])
        got = [robust_log_curve(*(g[x].to_numpy(float) for x in ("_t", "_rate", "_weight")))] if g["_t"].nunique() > 2 else []
        return pd.DataFrame([(g[by].iloc[0], *x) for x in got], columns=[by, "a", "c", "d", "cost"])

    rows = series.select(by, F.col(t).cast("double").alias("_t"), F.col(rate).cast("double").alias("_rate"), F.col(weight).cast("double").alias("_weight"))
    return rows.groupBy(by).applyInPandas(fit, f"{by} string, a double, c double, d double, cost double")
