"""Language ID by error-correcting output codes over hashed byte n-grams.

Every language gets a codeword of bits, far from the others. A binary classifier for each bit adds
up log ratios of n-gram frequencies between the languages with the bit set and those without.
Decoding adds each bit's logistic loss, weighted by how often that bit was right for that language
in training, and takes the codeword of the least loss; its share among exp(-loss) is the score. A
lead below `lead` over the second is flagged as ambiguous.

N-grams are of 1 to 3 bytes of the whole text in lower case, ASCII without letters as a space.
Frequencies come from at most `per_language` training texts of each language, those of the smallest
hashes of (doc_id, text), whatever repeats: the documented bound of the training sample. `und` with
score 0 for null texts, texts without a letter, and when nothing was learned; with one language
learned, it is every other text's. Ties go to the first language by name. Repeated rows have one
verdict, texts of any length are read whole, extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import slices
from .text import trim, utf8

SIZE, PER_LANGUAGE, LEAD = 4096, 2000, 0.2
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[:128] = 32
PLAIN[97:123] = np.arange(97, 123)
VERDICT = "lang_pred string, score double, second string, ambiguous boolean"


def features(column: pa.Array | pa.ChunkedArray):
    """Row ranges of a text column and their n-gram frequencies, few rows at a time."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    data, offsets = utf8(column)
    data = PLAIN[data]
    for i, j in slices(offsets, 200_000):
        part = data[offsets[i] : offsets[j]].astype(np.uint32)
        size = np.diff(offsets[i : j + 1])
        of = np.repeat(np.arange(j - i), size) * SIZE
        left = np.repeat(offsets[i + 1 : j + 1], size) - np.arange(offsets[i], offsets[j])
        counts, gram = np.zeros((j - i) * SIZE, np.float32), np.zeros(len(part), np.uint32)
        for n in (1, 2, 3):
            gram = (gram[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            inside = left[: len(gram)] >= n
            place = ((gram[inside] + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(of[: len(gram)][inside] + place, minlength=len(counts)).astype(np.float32)
        counts = counts.reshape(j - i, SIZE)
        yield i, j, counts / np.maximum(counts.sum(1, keepdims=True), 1)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: of many random codes the one whose nearest rows differ most."""
    if n < 2:
        return np.ones((n, 1))
    bits = max(7, int(np.ceil(6 * np.log2(n))))
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(500):
        code = rng.choice([-1.0, 1.0], (n, bits))
        if (abs(code.sum(0)) == n).any():
            continue
        apart = ((bits - code @ code.T) / 2)[~np.eye(n, dtype=bool)].min()
        if apart > far:
            best, far = code, apart
    return best if best is not None else np.where(np.arange(n)[:, None] >> np.arange(bits) & 1, 1.0, -1.0)


class Model:
    def __init__(self, names: list[str], frequencies: np.ndarray):
        self.names, self.code = names, codewords(len(names))
        self.trust = np.ones_like(self.code)
        if not names:  # nothing was learned; verdict() asks nothing of such a model
            self.weights, self.middle = np.zeros((SIZE, 1), np.float32), np.zeros(1)
            return
        smooth = frequencies + 1e-5
        smooth /= smooth.sum(1, keepdims=True)
        on, off = (self.code > 0).T.astype(float), (self.code <= 0).T.astype(float)
        mean = lambda x: (x @ smooth + 1e-12) / np.maximum(x.sum(1, keepdims=True), 1) + 1e-9
        self.weights = (np.log(mean(on)) - np.log(mean(off))).T if len(names) > 1 else np.ones((SIZE, 1))
        typical = np.abs(smooth @ self.weights).mean(0)
        self.weights = (self.weights * (4 / np.maximum(typical, 1e-9))).astype(np.float32)
        centre = smooth @ self.weights  # the middle between the languages with and without the bit
        self.middle = np.array([(centre[self.code[:, b] > 0, b].min() + centre[self.code[:, b] <= 0, b].max()) / 2 if len(names) > 1 else 0 for b in range(self.code.shape[1])])

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights - self.middle

    def losses(self, margins: np.ndarray) -> np.ndarray:
        each = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (each * self.trust[None]).sum(2)


def learn(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE) -> Model:
    """A model from text and non-null lang of the rows for which `learnable` holds."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(learnable).select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((0, SIZE)))
    of = {name: i for i, name in enumerate(names)}
    over = [n for n in names if sizes[n] > per_language]
    sample = rows
    if over:  # a hash that at least per_language rows of a language don't pass, in one aggregate; then, without texts, the exact one; then the rows
        place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        below = lambda cuts: F.col("h") <= F.create_map(*[F.lit(x) for n in names for x in (n, cuts.get(n, 2**63 - 1))])[F.col("lang")]
        share = lambda n: min(1.0, per_language / sizes[n] + 2e-4)
        about = rows.agg(*[F.percentile_approx(F.when(F.col("lang") == n, F.col("h")), share(n), 10_000) for n in over]).first()
        few = rows.where(below(dict(zip(over, about)))).select("lang", "h").withColumn("_r", place).where(F.col("_r") <= per_language)
        exact = {r["lang"]: r["h"] for r in few.groupBy("lang").agg(F.max("h").alias("h")).collect() if r["lang"] in over}
        sample = rows.where(below(exact)).withColumn("_r", place).where(F.col("_r") <= per_language)
    sample = sample.select("lang", "text")

    def summed(make, width: int) -> np.ndarray:
        """Sums of make(x, language numbers) by language, one row a task and language."""
        def run(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                langs = np.array([of[v] for v in batch["lang"].to_pylist()], np.int64)
                for i, j, x in features(batch["text"]):
                    y = make(x, langs[i:j])
                    for k in np.unique(langs[i:j]):
                        total[k] = total.get(k, 0) + y[langs[i:j] == k].sum(0)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in total]), pa.array([v.astype(float).tobytes() for v in total.values()], pa.binary())], ["lang", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py()) for v in table["sums"])
            return pa.table([table["lang"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["lang", "sums"])

        out = np.zeros((len(names), width))
        for r in sample.mapInArrow(run, "lang string, sums binary").groupBy("lang").applyInArrow(add, "lang string, sums binary").collect():
            out[of[r["lang"]]] = np.frombuffer(bytes(r["sums"]))
        return out

    model = Model(names, summed(lambda x, _: x, SIZE))
    code, bits = model.code, model.code.shape[1]
    right = summed(lambda x, y: np.concatenate([model.margins(x) * code[y] > 0, np.ones((len(y), 1))], 1), bits + 1)
    model.trust = (right[:, :bits] + 1) / (right[:, bits:] + 2)
    model.trust *= bits / model.trust.sum(1, keepdims=True)
    return model


def verdict(docs: DataFrame, model: Model, text: str = "text", lead: float = LEAD) -> Column:
    """A column of struct(lang_pred, score, second, ambiguous) for a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers a bit, bits by the number of languages

    @F.arrow_udf(VERDICT)
    def judge(column: pa.Array) -> pa.Array:
        m, n = shared.value, len(column)
        best, second, share, gap = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        if not m.names:
            return pa.StructArray.from_arrays([pa.array(["und"] * n), pa.array(share), pa.array([None] * n, pa.string()), pa.array([False] * n)], ["lang_pred", "score", "second", "ambiguous"])
        for i, j, x in features(column):
            loss = m.losses(m.margins(x))
            order = np.argsort(loss, 1, kind="stable")
            p = np.exp(loss.min(1, keepdims=True) - loss)
            p = np.sort(p / p.sum(1, keepdims=True), 1)[:, ::-1]
            best[i:j], second[i:j], share[i:j] = order[:, 0], order[:, min(1, len(m.names) - 1)], p[:, 0]
            gap[i:j] = p[:, 0] - p[:, 1] if p.shape[1] > 1 else 1
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        trim()
        name = [m.names[b] if k else "und" for b, k in zip(best, letters)]
        return pa.StructArray.from_arrays([
            pa.array(name, pa.string()), pa.array(np.where(letters, share, 0.0)),
            pa.array([m.names[s] if k and len(m.names) > 1 else None for s, k in zip(second, letters)], pa.string()), pa.array(letters & (gap < lead))],
            ["lang_pred", "score", "second", "ambiguous"])

    return judge(F.col(text).cast("string"))
