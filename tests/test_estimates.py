"""Known answers and properties of estimators, files, headers, models and block finding."""

import hashlib
import itertools
import json
import random
import re
import threading
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.functions import ids, network, rules
from tidemark.operators import coverage, estimators, models
from tidemark.plans import registry
from tidemark.sources import files


def test_good_turing_mass(spark):
    cc = spark.createDataFrame([(1, 120), (2, 40), (3, 24), (4, 13), (5, 15), (6, 5), (7, 11), (8, 2), (9, 2), (10, 1), (12, 3), (16, 1), (40, 1)], "r long, species long")
    rows = estimators.good_turing(cc).collect()
    n = sum(r["r"] * r["species"] for r in rows)
    assert abs(sum(r["p"] * r["species"] for r in rows) - (1 - 120 / n)) < 1e-9
    assert [r["p"] for r in rows] == sorted(r["p"] for r in rows) and all(r["p"] < r["r"] / n for r in rows if r["r"] < 3)


def test_prevalence_of_a_known_case(spark):
    assert abs(estimators.prevalence(88, 1000, 0.9, 0.8) - 9.9) < 1e-9
    g = spark.createDataFrame([("a", 88, 1000), ("b", 0, 50), ("c", 50, 50), ("d", 0, 0)], "loc string, k long, n long")
    out = estimators.prevalence_interval(g.where("n > 0"), "loc", 0.9, 0.8, 300)
    rows = {r["loc"]: r for r in out.collect()}
    assert rows["a"]["lower"] < 9.9 < rows["a"]["upper"] and rows["b"]["upper"] < 1e-9 and 0 <= rows["c"]["lower"] <= rows["c"]["upper"]
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in rows.values()}  # seeded
    wide = {t: {r["loc"]: r for r in estimators.prevalence_interval_adjusted(g, "loc", 0.9, 0.8, 300, t).collect()} for t in (1.0, 0.95, 0.5)}
    assert all(abs(w["a"]["point"] - 9.9) < 1e-9 and w["b"]["lower"] == 0 and 0 < w["b"]["upper"] < 12 and w["c"]["upper"] == 100 and w["d"]["lower"] is None for w in wide.values())
    width = [w["a"]["upper"] - w["a"]["lower"] for w in wide.values()]
    assert width == sorted(width) and width[2] > 1.5 * width[1]
    a = wide[1.0]["a"]
    assert abs(np.log(a["upper"] / a["lower"]) / 2 - 1.959964 * np.sqrt(0.912 / 88 + 0.1 / 270 + 0.2 / 240)) < 1e-6


@pytest.mark.parametrize("trust", [1.0, 0.8])
def test_adjusted_intervals_hold_the_true_prevalence(spark, trust):
    """Populations of a known prevalence, found with a precision and a recall that differ from the measured ones by as much as the test set and the trust allow."""
    rng, truth, precision, recall, tested, n = np.random.default_rng(6), 0.08, 0.85, 0.8, 400, 3000
    cases, rows = tested * trust**2, []
    for i in range(600):
        p, r = (rng.beta(x * cases, (1 - x) * cases) for x in (precision, recall))
        if trust < 0.9:
            p, r = np.clip(np.array([p, r]) + rng.normal(0, (1 - trust) * 0.2, 2), 0.05, 0.99)
        rows.append((str(i), int(rng.binomial(n, truth * r / p)), n))
    ends = estimators.prevalence_interval_adjusted(spark.createDataFrame(rows, "loc string, k long, n long"), "loc", precision, recall, tested, trust).collect()
    held = np.mean([e["lower"] <= truth * 100 <= e["upper"] for e in ends])
    assert 0.92 <= held <= 0.98


def test_shuffling_keeps_both_columns(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(9), rng.randrange(5)) for i in range(500)]
    out = estimators.shuffled(spark.createDataFrame(rows, "k long, u long, a long"), "k", "u", "a", 3).collect()
    for rep in (1, 2, 3):
        assert sorted(r["u"] for r in out if r["rep"] == rep) == sorted(u for _, u, _ in rows)
        assert sorted(r["a"] for r in out if r["rep"] == rep) == sorted(a for _, _, a in rows)
    assert len({tuple((r["u"], r["a"]) for r in sorted(out) if r["rep"] == rep) for rep in (1, 2, 3)}) == 3


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_shuffling_reads_once_and_pairs_by_place(spark, monkeypatch, block):
    """Against two plain sorts, with repeated keys, in one block and in many; the rows aren't made anew for each count and deal."""
    monkeypatch.setattr(estimators, "BLOCK", block)
    made, rng = spark.sparkContext.accumulator(0), random.Random(3)
    rows = [(i // 2 if i < 60 else i, rng.randrange(9), rng.randrange(5)) for i in range(700)]

    def once(batches):
        for b in batches:
            made.add(len(b))
            yield b

    out = estimators.shuffled(spark.createDataFrame(rows, "k long, u long, a long").mapInPandas(once, "k long, u long, a long"), "k", "u", "a", 2).collect()
    order = lambda name, rep, at: [r[at] for r in sorted(rows, key=lambda r: (hashlib.md5(f"{name}:{r[0]}:{rep}".encode()).hexdigest(), r[at]))]
    for rep in (1, 2):
        assert sorted((r["u"], r["a"]) for r in out if r["rep"] == rep) == sorted(zip(order("a", rep, 1), order("b", rep, 2)))
    assert made.value == len(rows)


def test_permutations_of_odd_rows_as_in_sql(spark, monkeypatch):
    """In many blocks and a round for each replicate; repeated keys, keys and members that aren't known, which come last; no rows."""
    rng = random.Random(5)
    rows = [(i // 3 if i < 90 else None if i < 100 else i, None if i % 4 == 0 else rng.randrange(60), rng.randrange(5)) for i in range(500)]
    monkeypatch.setattr(estimators, "BLOCK", 40)
    monkeypatch.setattr(estimators, "ROUND", len(rows), raising=False)
    sql = registry.oracle_sql()["permutation_blocks"]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE comments (cid BIGINT, uid BIGINT, small_author BIGINT)")
    for some in (rows, []):
        duck.execute("DELETE FROM comments")
        duck.executemany("INSERT INTO comments VALUES (?, ?, ?)", some) if some else None
        want = duck.execute("WITH " + sql[sql.index("c AS (SELECT cid") :]).fetchall()
        comments = spark.createDataFrame(some, "cid long, uid long, small_author long")
        assert sorted(map(tuple, registry._queries["permutation_blocks"](SimpleNamespace(comments=comments)).collect())) == sorted(want)


def test_permutations_hold_one_round_on_disk(spark, monkeypatch):
    """Six replicates take less than three times the shuffle files that one takes."""
    monkeypatch.setattr(estimators, "ROUND", 1, raising=False)
    rows = spark.range(20_000).select("id", (F.col("id") * 7919 % 5003).alias("u"), (F.col("id") * 104729 % 7).alias("a"))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> dict[str, int]:
        return {f.getPath(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if "shuffle_" in f.getName()}

    def most(replicates: int) -> int:
        before, peak, done = set(files()), [0], threading.Event()

        def watch() -> None:
            while not done.wait(0.1):
                peak[0] = max(peak[0], sum(n for f, n in files().items() if f not in before))

        watcher = threading.Thread(target=watch)
        watcher.start()
        assert estimators.permutation_blocks(rows, "id", "u", "a", replicates).collect()
        done.set()
        watcher.join()
        return peak[0]

    assert most(6) < 3 * most(1)


def test_log_curve_finds_its_parameters(spark):
    t = np.array([0, 7, 14, 21, 40, 63, 90], float)
    rows = [("x", float(u), float(0.3 * np.log(u + 0.5) + 0.1), i + 1.0) for i, u in enumerate(t)]
    rows += [("y", *r[1:3], 0.0 if i == 3 else r[3]) for i, r in enumerate(rows)] + [("y", None, 0.5, 1.0), ("few", 0.0, 1.0, 1.0), ("few", 7.0, 1.0, 1.0)]
    got = {r["s"]: r for r in estimators.log_curves(spark.createDataFrame(rows, "s string, t double, rate double, w double"), "s", "t", "rate", "w").collect()}
    assert sorted(got) == ["x", "y"]
    assert all(np.allclose([r["a"], r["c"], r["d"]], [-0.5, 0.3, 0.1], atol=1e-4) and r["cost"] < 1e-9 for r in got.values())


def test_log_curve_is_robust_and_best():
    """One wild point hardly moves it, and no point of a dense grid of all three parameters costs less."""
    rng = np.random.default_rng(5)
    t = np.arange(0, 140, 7.0)
    y = 2.0 * np.log(t + 3) + 1 + rng.normal(0, 0.02, len(t))
    y[12] += 40
    w = np.ones(len(t))
    a, c, d, cost = estimators.robust_log_curve(t, y, w)
    assert abs(a + 3) < 1 and abs(c - 2) < 0.2 and abs(d - 1) < 0.5
    value = lambda a, c, d: np.sum(np.sqrt(1 + (y - c * np.log(t - a) - d) ** 2) - 1)
    assert abs(value(a, c, d) - cost) < 1e-9
    assert all(value(a + x, c + u, d + v) >= cost - 1e-7 for x in np.linspace(-0.5, 0.5, 11) for u in np.linspace(-0.1, 0.1, 11) for v in np.linspace(-0.3, 0.3, 11))


@pytest.mark.parametrize("hot", [1000, 3, 0])
def test_shared_members_with_hot_ones(spark, hot):
    rng = random.Random(hot)
    edges = {(g, m) for g in range(12) for m in range(9) if rng.random() < (0.9 if m < 3 else 0.3)}
    got = coverage.shared_members(spark.createDataFrame(sorted(edges), "g long, m long"), "g", "m", 2, 2, hot).collect()
    own = {g: {m for h, m in edges if h == g} for g in range(12)}
    want = {(a, b, len(own[a] & own[b])) for a, b in itertools.combinations(range(12), 2) if len(own[a]) > 1 and len(own[b]) > 1 and len(own[a] & own[b]) > 1}
    assert {tuple(r) for r in got} == want


def test_shared_members_in_tasks_of_bounded_size(spark, monkeypatch):
    """As many tasks as the pairs ask for, which adaptive execution doesn't join again, with hot members and without."""
    monkeypatch.setattr(coverage, "TASK_ROWS", 40)
    rng = random.Random(5)
    edges = {(g, m) for g in range(15) for m in range(9) if rng.random() < 0.6}
    own = {g: {m for h, m in edges if h == g} for g in range(15)}
    want = {(a, b, len(own[a] & own[b])) for a, b in itertools.combinations(range(15), 2) if len(own[a]) > 1 and len(own[b]) > 1 and len(own[a] & own[b]) > 1}
    for hot in (1000, 8):
        out = coverage.shared_members(spark.createDataFrame(sorted(edges), "g long, m long"), "g", "m", 2, 2, hot)
        assert {tuple(r) for r in out.collect()} == want
        dealt = [int(x) for x in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", out._jdf.queryExecution().executedPlan().toString())]
        assert dealt and (hot < 1000 or max(dealt) >= 8)


def test_sidecars_need_a_timestamp(spark, tmp_path):
    (tmp_path / "v_1700000001.5.json").write_text('{"a": 1}')
    assert files.read_sidecars(spark, str(tmp_path), "a long").first().asDict() == {"a": 1, "at": 1700000001.5}
    (tmp_path / "v.json").write_text('{"a": 2}')
    with pytest.raises(Exception, match="timestamp"):
        files.read_sidecars(spark, str(tmp_path), "a long").collect()


def test_sidecars_are_written_by_many_tasks(spark, tmp_path):
    """However few bytes they have, and read without a column for their folders."""
    rows = spark.range(300).select(F.col("id").alias("d")).coalesce(1)
    files.write_sidecars(rows, F.concat((F.col("d") + 1700000000).cast("string"), F.lit(".25_v")), str(tmp_path / "s"))
    assert len({p.name.split("-")[1] for p in (tmp_path / "s").rglob("part-*.json")}) > 3
    got = files.read_sidecars(spark, str(tmp_path / "s"), "d long")
    assert got.columns == ["d", "at"] and sorted(map(tuple, got.collect())) == [(i, 1700000000.25 + i) for i in range(300)]


def test_representatives_read_texts_once_for_classes_and_once_for_documents(spark):
    from types import SimpleNamespace

    docs = spark.createDataFrame([(1, "a", "Ab ab c-D"), (1, "a", "ab"), (2, "a", "zz"), (3, "b", "ab"), (4, "b", None), (5, "b", "123")], "doc_id long, lang string, text string")
    registry.queries()
    out = registry._queries["representative_docs"](SimpleNamespace(table=lambda name: docs))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    tf = {("a", 1): {"ab": 3, "c": 1, "d": 1}, ("a", 2): {"zz": 1}, ("b", 3): {"ab": 1}}
    k = {x: sum((n.get(x[1], 0) for (lang, _), n in tf.items() if lang == x[0])) for x in [(lang, t) for lang in "ab" for t in ("ab", "c", "d", "zz")]}
    value = lambda lang, t: k[lang, t] * np.log(1 + 3.5 / (k["a", t] + k["b", t]))
    want = {(lang, d): sum(n * value(lang, t) for t, n in x.items()) / np.sqrt(sum(n * n for n in x.values())) for (lang, d), x in tf.items()}
    got = {(r["lang"], r["doc_id"]): r["score"] for r in out.collect()}
    assert sorted(got) == sorted(want) and all(abs(got[x] - want[x]) < 1e-3 for x in want)


def test_headers_and_hours(spark):
    rows = [({"x-cache": "TCP_MISS from a1-2-3-4.deploy x", "x-parent-response-time": "1,9.9.9.9, 2,8.8.8.8, 3,7.7.7.7"},), ({"x-cache": "NONE"},), ({},), (None,)]
    got = spark.createDataFrame(rows, "h map<string,string>").select(network.cache_path(F.col("h")).alias("p")).select("p.*").collect()
    assert (got[0]["cache_hit"], got[0]["cache_ip"], got[0]["ips"], got[0]["final_ip"]) == (False, "1.2.3.4", ["1.2.3.4", "7.7.7.7", "8.8.8.8"], "9.9.9.9")
    assert all(r["cache_hit"] is None and r["ips"] == [] for r in got[1:])
    at = spark.sql("SELECT timestamp'2024-04-10 19:00:00' AS t, array('America/Toronto') AS a, array('America/Toronto', 'UTC') AS b, cast(array() AS array<string>) AS e, cast(null AS array<string>) AS n")
    assert list(at.select(*[network.local_hour(F.col("t"), F.col(x)) for x in "aben"]).first()) == [15, 17, None, None]


def test_rules_on_odd_text(spark):
    df = spark.createDataFrame([("#été #a_1",), ("##x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(rules.hashtags(F.col("t"))).collect()] == [["#a_1"], ["#x"], [], None]
    assert df.select(rules.hashtags(F.col("t"), True)).first()[0] == ["#été", "#a_1"]
    kleene = spark.sql("SELECT * FROM VALUES (null, null), (null, 1L), (\"item doesn't exist\", null) t(s, i)")
    assert [r[0] for r in kleene.select(rules.success(F.col("s"), F.col("i"))).collect()] == [None, True, False]
    i = spark.sql("SELECT 1712775688L AS s, 5L AS m, 3L AS c, 7L AS g").select(ids.compose(*map(F.col, "smcg")).alias("id"))
    assert i.select(ids.second(F.col("id")), ids.millisecond(F.col("id")), ids.counter(F.col("id")), ids.geo(F.col("id"))).first() == (1712775688, 5, 3, 7)


@pytest.mark.parametrize("name,least", [("train_logistic", 0.9), ("train_forest", 0.7), ("train_boosting", 0.7), ("train_stacking", 0.9)])
def test_classifiers_rank_unseen_rows(spark, name, least):
    rows = registry.queries()[name](spark, SMALL.replace("0.001", "0.01")).collect()
    hit, miss = ([r["probability"] for r in rows if r["y"] == y] for y in (1.0, 0.0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in hit for b in miss])
    print(name, auc, len(hit), len(miss))
    assert len(hit) > 3 and auc > least


@pytest.mark.parametrize("diversity,most", [(0.4, 1000), (0.4, 10), (0.1, 1000), (0.1, 10)])
def test_mmr_against_a_loop(spark, diversity, most):
    """Over all members, whether topics are picked in tasks or in rounds."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 5)).astype(np.float32)
    v[7], v[9] = v[5], -v[5]
    df = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "vec_id long, label long, embedding array<float>")
    got = sorted((r["topic"], r["rank"], r["key"]) for r in models.diverse_representatives(df, "label", "vec_id", "embedding", 6, diversity, most).collect())
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for t in (0, 1):
        own = [i for i in range(60) if i % 2 == t]
        mean = v[own].astype(float).mean(0)
        near, chosen = unit @ mean / np.linalg.norm(mean), []
        while len(chosen) < 6:
            value = {i: (1 - diversity) * near[i] - (diversity * max(unit[i] @ unit[j] for j in chosen) if chosen else 0) for i in own if i not in chosen}
            chosen.append(max(value, key=lambda i: (round(value[i], 9), -i)))
        assert [k for topic, _, k in got if topic == t] == chosen


def test_least_squares_and_bits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 2 * x[:, 0] - x[:, 1] + 0.5 + rng.normal(size=200) * 0.1
    got = {r["feature"]: r["value"] for r in models.least_squares(spark.createDataFrame(np.c_[x, y].tolist(), "a double, b double, y double"), ["a", "b"], "y").collect()}
    want = np.linalg.lstsq(np.c_[x, np.ones(200)], y, rcond=None)[0]
    assert np.allclose([got["a"], got["b"], got["intercept"]], want, atol=1e-8) and got["r2"] > 0.98
    bits = spark.createDataFrame([(b + 2 * b + 4 * int(rng.integers(2)),) for b in rng.integers(0, 2, 300).tolist()], "w long")
    c = {(r["bit"], r["other"]): r["coefficient"] for r in models.bit_dependence(bits, "w", 4).collect()}
    assert c[0, 1] > 1 and c[1, 0] > 1 and abs(c[0, 2]) < 1 and c[0, 3] == c[3, 0] == 0


def test_topics_of_known_blobs(spark):
    """Four directions of known sizes, one of too few rows, and rows without a direction; a sample gives the same topics."""
    rng = np.random.default_rng(12)
    centres, sizes, rows = np.array([[1, 0.4, 0, 0, 0, 0], [1, -0.4, 0, 0, 0, 0], [-1, 0, 0.6, 0, 0, 0], [-1, 0, -0.6, 0, 0, 0]]), [60, 45, 30, 6], []
    for t, n in enumerate(sizes):
        rows += [(len(rows) + i, (centres[t] + rng.normal(0, 0.03, 6)).tolist(), t) for i in range(n)]
    rows += [(900, [0.0] * 6, 3), (901, None, 3), (902, [], 3)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, t int").repartition(3)
    want = {i: t if t < 3 else -1 for i, _, t in rows}
    for sample in (1000, 100):
        got = {r["vec_id"]: r["topic"] for r in models.cluster_topics(df, "vec_id", "v", 4, sample).collect()}
        assert got == want
    assert {r["topic"] for r in models.cluster_topics(df.where("vec_id >= 900"), "vec_id", "v", 4).collect()} == {-1}


def test_scores_and_folds_have_the_values_of_their_models(spark):
    """batch_score repeats its model's own probabilities; cross_validate's means are those of its folds; project_2d keeps what PCA keeps."""
    from types import SimpleNamespace

    from pyspark.ml.functions import vector_to_array

    from tidemark.plans import models as plans

    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    v = SimpleNamespace(table=lambda name: e)
    rows = plans.examples(v)
    model = plans.logistic().fit(rows.where("fold = 0"))
    w, b = np.array(model.coefficients), model.intercept
    x = {r["vec_id"]: np.array(r["x"]) for r in rows.select("vec_id", vector_to_array("features").alias("x")).collect()}
    got = registry._queries["batch_score"](v).collect()
    assert len(got) == len(x) and all(abs(r["probability"] - 1 / (1 + np.exp(-(w @ x[r["vec_id"]] + b)))) < 1e-9 and r["predicted"] == (r["probability"] > 0.43) for r in got)
    found = {r["metric"]: (r["mean"], r["sd"]) for r in registry._queries["cross_validate"](v).collect()}
    right = {k: [] for k in range(plans.FOLDS)}
    for r in models.out_of_fold(rows, plans.logistic(), plans.FOLDS).select("fold", "y", "probability").collect():
        right[r["fold"]].append((r["probability"] > 0.5) == (r["y"] == 1))
    shares = [np.mean(x) for x in right.values()]
    assert abs(found["accuracy"][0] - np.mean(shares)) < 1e-4 and abs(found["accuracy"][1] - np.std(shares)) < 1e-4  # folds' measures have four places
    flat = np.array([x[k] for k in sorted(x)])
    axes = np.linalg.svd(flat - flat.mean(0), full_matrices=False)[2][:2]
    xy = {r["vec_id"]: (r["x"], r["y"]) for r in registry._queries["project_2d"](v).collect()}
    theirs = np.array([xy[k] for k in sorted(xy)])
    for i in (0, 1):
        assert np.isclose(abs(np.corrcoef(theirs[:, i], flat @ axes[i])[0, 1]), 1, atol=1e-6)
