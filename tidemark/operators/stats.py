"""Tests, regressions and classifier measures from one-row aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(x: Column, when: Column, name: str) -> list[Column]:
    v = F.when(when, x)
    return [F.avg(v).alias(f"m_{name}"), F.var_samp(v).alias(f"v_{name}"), F.count(v).alias(f"n_{name}")]


#: Intervals of Simpson's rule in t_p_value; an even number.
STEPS = 2000


def t_p_value(t: Column, dof: Column) -> Column:
    """The two-sided p value of Student's t: with t = sqrt(dof) * tan(x) the density is cos(x)**(dof - 1), and what lies beyond t is the share of its integral.

    Both integrals end where the density is nil (40 standard deviations), so that the steps stay fine for any number of rows.
    """
    end = F.least(F.lit(math.pi / 2), 40 / F.sqrt(dof))
    start = F.least(F.atan(F.abs(t) / F.sqrt(dof)), end)

    def integral(low: Column) -> Column:
        step = (end - low) / STEPS
        weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        parts = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: weight(i) * F.pow(F.greatest(F.cos(low + i * step), F.lit(0.0)), dof - 1))
        return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) * step

    return F.when(t.isNotNull() & (dof > 0), integral(start) / integral(F.lit(0.0)))


def t_test(df: DataFrame, x: Column, a: Column, b: Column, equal_variance: bool = False) -> DataFrame:
    """t, degrees of freedom and two-sided p of the means of x where a and where b hold, from one pass."""
    return t_of(df.agg(*moments(x, a, "a"), *moments(x, b, "b")), equal_variance)


def t_of(one: DataFrame, equal_variance: bool = False, keep: list[str] | None = None) -> DataFrame:
    """t_test() from the moments m_, v_, n_ of samples a and b, a row a test; `keep` stays."""
    ma, va, na, mb, vb, nb = (F.col(f"{k}_{s}") for s in "ab" for k in "mvn")
    if equal_variance:
        dof = na + nb - 2
        se = F.sqrt(((na - 1) * va + (nb - 1) * vb) / dof * (1 / na + 1 / nb))
    else:
        p, q = va / na, vb / nb
        dof, se = F.try_divide(F.pow(p + q, 2), F.try_divide(p * p, na - 1) + F.try_divide(q * q, nb - 1)), F.sqrt(p + q)
    rows = one.select(*(keep or []), F.try_divide(ma - mb, se).alias("_t"), dof.cast("double").alias("_dof"))
    return rows.select(*(keep or []), F.round("_t", 4).alias("t"), F.round("_dof", 4).alias("dof"), F.round(t_p_value(F.col("_t"), F.col("_dof")), 6).alias("p"))


def regress(df: DataFrame, y: Column, x: Column) -> DataFrame:
    rows = df.select(y.cast("double").alias("y"), x.cast("double").alias("x"))
    return rows.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


def residuals(df: DataFrame, y: Column, x: Column) -> DataFrame:
    rows = df.withColumn("_y", y.cast("double")).withColumn("_x", x.cast("double"))
    line = rows.agg(F.regr_slope("_y", "_x").alias("_s"), F.regr_intercept("_y", "_x").alias("_i"))
    out = rows.crossJoin(F.broadcast(line))  # one row
    return out.withColumn("residual", F.col("_y") - F.col("_s") * F.col("_x") - F.col("_i")).drop("_y", "_x", "_s", "_i")


def confusion(df: DataFrame, label: Column, pred: Column, by: list[str] | None = None) -> DataFrame:
    n = lambda when: F.count_if(when)
    return df.groupBy(*(by or [])).agg(n(label & pred).alias("tp"), n(~label & pred).alias("fp"), n(label & ~pred).alias("fn"), n(~label & ~pred).alias("tn"))


def measures(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall and f1, 0 where a denominator is."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    return c.select(*(by or []), part(tp + tn, tp + fp + fn + tn).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))
