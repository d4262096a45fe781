"""What five filters take away in every order, by contraction of one contingency tensor for each part.

A document fails A with under 200 words, B with fewer distinct words than half of its words, C with over 3 % of
`[A-Z]` among its characters, D with one of `#$%&*|`, E if a document of a smaller doc_id has its text. Words are
`[^\\x20\\x09-\\x0D]+`. Spark counts documents by part and the five answers, a 2x2x2x2x2 tensor for each part and for each
of three measures (all, good, toxic). Every figure of a step is then a contraction of it, one
selector an axis: pass for earlier filters, fail for the step's own, all for those to come.

Equal texts are found by their SHA-256 in two aggregates and no join of texts: rows of one text, doc_id and
part are counted first, then each text's and part's rows at the smallest doc_id and above it, so a text that a third of the
rows share is one row a task. Labels come by doc_id to rows already counted; those without doc_id are dealt apart.

Defined cases: a null text is empty (it fails A and is like other empty texts, not B, C or D), a null lang is the part '', a null doc_id
is neither smaller than others nor larger, so such rows never fail E, and have no labels. Repeated rows count each, and
pass E together. A doc_id with several rows of labels has each label that one of them has. Ties don't arise, texts of any length are
read whole, extra columns are ignored; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Rows without doc_id are dealt to so many groups where others go by doc_id.
APART = 4096
#: What a selector takes along an axis, of the documents that pass and of those that fail.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.char_length(text), "D": text.rlike(r"[#$%&*|]")}


def outcomes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (whether they fail) and the measures: how many documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *[f.alias(name) for name, f in text_filters(text).items()])
    of_text = ["digest", *FILTERS[:4]]
    counted = rows.groupBy("doc_id", "part", *of_text).agg(F.count(F.lit(1)).alias("n"))
    no_id = F.col("doc_id").isNull()
    keyed = counted.select("*", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.when(no_id, F.pmod(F.xxhash64("digest"), F.lit(APART)) + 1).otherwise(0).alias("_apart"))
    labelled = labels.select(F.col("doc_id").cast("long").alias("_id"), "quality", "toxic").where("_id is not null").groupBy("_id").agg(
        *[F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]).withColumn("_apart", F.lit(0).cast("long"))
    told = keyed.join(labelled, ["_id", "_apart"], "left").fillna(0, ["good", "toxic"])
    # Of one text in one part, and with the same labels: how many rows, and how many of them have no doc_id or the smallest.
    kinds = told.groupBy(*of_text, "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(no_id, F.col("n")).otherwise(0)).alias("without"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"))
    smallest = F.min("least").over(Window.partitionBy("digest"))  # a row for each part and pair of labels
    kinds = kinds.withColumn("pass", F.col("without") + F.when(F.col("least") == smallest, F.col("at_least")).otherwise(0))
    e = F.explode(F.array(*[F.struct(F.lit(x).alias("E"), k.alias("n")) for x, k in ((False, F.col("pass")), (True, F.col("n") - F.col("pass")))]))
    cells = kinds.select("part", *FILTERS[:4], "good", "toxic", e.alias("e")).select("part", *FILTERS[:4], "e.E", "good", "toxic", "e.n")
    return cells.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(m)).alias(m) for m in MEASURES[1:]])


def steps() -> list[tuple[tuple[int, ...], int]]:
    """Every order of the filters and every place in it."""
    return [(order, s) for order in permutations(range(len(FILTERS))) for s in range(len(FILTERS))]


def contracted(tensor: np.ndarray, selectors: Sequence[Sequence[tuple[int, int]]]) -> np.ndarray:
    """Sums of a tensor (measure, A, ..., E) for each list of five selectors."""
    s = np.array(selectors, np.int64)
    return np.einsum("mabcde,sa,sb,sc,sd,se->ms", tensor, *(s[:, k] for k in range(len(FILTERS))), optimize=True)


def audited(cells: pd.DataFrame) -> pd.DataFrame:
    """All steps of all orders for one part, from its cells."""
    tensor = np.zeros((len(MEASURES), *[2] * len(FILTERS)), np.int64)
    tensor[(slice(None), *(cells[f].to_numpy().astype(int) for f in FILTERS))] = cells[list(MEASURES)].to_numpy().T
    every, axes = steps(), range(len(FILTERS))
    own = [order[s] for order, s in every]
    kept = contracted(tensor, [[PASS if k in order[: s + 1] else ALL for k in axes] for order, s in every])
    removed = contracted(tensor, [[FAIL if k == order[s] else PASS if k in order[:s] else ALL for k in axes] for order, s in every])
    failing = contracted(tensor, [[FAIL if k == f else ALL for k in axes] for f in axes])[0]
    alone = contracted(tensor, [[FAIL if k == f else PASS for k in axes] for f in axes])[0]
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, own, removed[0])
    return pd.DataFrame({
        "part": cells["part"].iloc[0], "filter_order": ["".join(FILTERS[k] for k in order) for order, _ in every], "step": [s + 1 for _, s in every],
        "kept": kept[0], "removed": removed[0], "redundant": failing[own] - removed[0], "unique_fails": alone[own],
        "good_lost": removed[1], "toxic_lost": removed[2], "shapley": shapley[own]})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (AUDIT) a part, order of the filters and step."""
    return outcomes(docs, labels).groupBy("part").applyInPandas(audited, AUDIT)
