"""Files of any shape: JSON that is broken or large, arrays that are cut off, trees of slices, schemas that drift."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import files, slices


def comment(i, **more):
    return {"cid": i, "text": "é\n\"q\"", "user": {"uid": i % 2, "follower_count": i, "following_count": 0, "other": 1}} | more


def answer(*cids):
    return {"data": {"comments": [comment(i) for i in cids]}}


@pytest.mark.parametrize("whole", [files.WHOLE, 0, 200])
def test_json_documents_of_any_shape(spark, tmp_path, whole):
    """The same documents whether files are read as rows, by line, or some of both."""
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("one.json", json.dumps(answer(1, 2), indent=2))
    put("rows.json", '{"data": {"comments": [\n' + ",\n".join(json.dumps(comment(i)) for i in (5, 6)) + "\n]}}")  # whole objects on lines of one document
    put("lines.json", "\n".join(["", json.dumps(answer(3)), json.dumps({"data": None}), json.dumps({"data": {}}), json.dumps({}), ""]))
    put("broken.json", "\r\n".join([json.dumps(answer(11)), json.dumps(answer(12))[:60], json.dumps(answer(13)), json.dumps(answer(14))]))
    put("broken_head.json", "\n".join([json.dumps(answer(20))[:50], json.dumps(answer(21))]))
    put("cut.json", '{"data": {"comments": [{"cid": 9')
    put("empty.json", "\n \n")
    rows = files.read_json_files(spark, str(tmp_path), files.COMMENTS, whole)
    got = files.comments(files.read_json_documents(spark, str(tmp_path), files.COMMENTS, whole)).collect()
    assert sorted((r["cid"], r["uid"], r["text"]) for r in got) == [(i, i % 2, "é\n\"q\"") for i in (1, 2, 3, 5, 6, 11, 13, 14, 21)]
    bad = {(r["file"].rsplit("/", 1)[1], r["text"]) for r in files.quarantined(rows).collect()}
    assert bad == {("broken.json", json.dumps(answer(12))[:60]), ("broken_head.json", json.dumps(answer(20))[:50]), ("cut.json", '{"data": {"comments": [{"cid": 9')}


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    with open(tmp_path / "big.json", "w") as f:
        for i in range(20_001):
            f.write((json.dumps(answer(i)) if i % 7 else json.dumps(answer(i))[:40]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = files.read_json_files(spark, str(tmp_path), files.COMMENTS, whole=1000)
        tasks = rows.select("file", F.spark_partition_id().alias("p")).distinct().count()
        cids = {r["cid"] for r in files.comments(rows.where(f"doc.{files.CORRUPT} is null")).select("cid").collect()}
        assert tasks > 5 and cids == {i for i in range(20_001) if i % 7} and files.quarantined(rows).count() == sum(i % 7 == 0 for i in range(20_001))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_salvage_keeps_what_is_whole(spark):
    rows = [(1, '[{"k": 1}, {"k": 2, "s": "x } ] {"}, {"k": 3'), (2, '[{"k": 4}]'), (3, "["), (4, ""), (5, None), (6, "no json"), (7, '[{"k": "five"}]'), (8, '[{"k": 8},\n {"k": 9}'), (9, '[1, {"k": 1}]'),
            (10, '[{"k": 10, "s": "a\\\\"}, {"k": 11, "s": "\\"}"}, {"k": 12]'), (11, '[{"k": 13}] {"k": 14}'), (12, '\\"[{"k": 15}]'), (13, '[{"k": 16, "s": {"t": [{}, []]}}, [], {"k": 17}]'), (14, '[{"k": 18, "s": "é文"}')]
    got = files.salvage(spark.createDataFrame(rows, "d long, t string"), "t", "k bigint, s string").select("d", "record.k", f"record.{files.CORRUPT}", "record.s").collect()
    good = sorted((r["d"], r["k"]) for r in got if r[files.CORRUPT] is None)
    assert good == [(1, 1), (1, 2), (2, 4), (8, 8), (8, 9), (10, 10), (10, 11), (11, 13), (13, 16), (14, 18)]
    assert [r["d"] for r in got if r[files.CORRUPT] is not None] == [7] and {r["s"] for r in got if r["k"] in (10, 11, 18)} == {"a\\", '"}', "é文"}


def test_cutting_against_a_decoder():
    """Arrays cut anywhere give the records that lie before the cut, whatever their strings hold."""
    rng, read = random.Random(2), json.JSONDecoder()
    texts = []
    for _ in range(300):
        records = [{"s": "".join(rng.choice('a"\\{}[],é ') for _ in range(rng.randrange(9))), "n": [{}, [rng.randrange(9)], {"x": "]"}][: rng.randrange(4)]} for _ in range(rng.randrange(6))]
        text = json.dumps(records, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        texts.append(text[: rng.randrange(len(text) + 1)] if rng.random() < 0.7 else text)
    raw = [t.encode() for t in texts]
    row, start, end = files.cut_records(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    whole = b"".join(raw)
    for i, text in enumerate(texts):
        want, at = [], 1
        while at < len(text):
            at += len(text[at:]) - len(text[at:].lstrip(", \n"))
            try:
                record, at = read.raw_decode(text, at)
            except json.JSONDecodeError:
                break
            want.append(record)
        assert [json.loads(whole[a:b]) for r, a, b in zip(row, start, end) if r == i] == want


def test_cutting_takes_linear_time():
    one = json.dumps([{"k": i, "s": "a } b, {"} for i in range(40_000)]).encode()

    def seconds(times: int) -> float:
        data = np.frombuffer(one[:-1] * times, np.uint8)
        began = time.perf_counter()
        files.cut_records(data, np.array([0, len(data)]))
        return time.perf_counter() - began

    seconds(1)
    assert min(seconds(8) for _ in range(3)) < 20 * min(seconds(1) for _ in range(3))


def test_slices_are_pruned(spark, tmp_path):
    rows = spark.range(4000).select("id", F.timestamp_seconds(F.col("id") * 61 % 10_800 + 1_699_999_200).alias("ts"))  # 22, 23 and 0 o'clock
    path = str(tmp_path / "tree")
    slices.write_slices(rows, path, "ts", ["hour", "minute"])
    wanted = (F.col("hour") == 23) | (F.col("minute") == 42)
    got = slices.read_slices(spark, path, wanted)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((hour#" in plan
    want = rows.where((F.hour("ts") == 23) | (F.minute("ts") == 42))
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 62 < 180 == len(spark.read.parquet(path).inputFiles())
    seconds = str(tmp_path / "seconds")
    slices.write_slices(rows.limit(20), seconds, "ts")
    assert spark.read.parquet(seconds).columns == ["id", "ts", "hour", "minute", "second"]


def test_trees_without_keys_in_their_folders(spark, tmp_path):
    for h, m, s in ((19, 5, 0), (19, 42, 7), (3, 42, 59), (3, 5, 1)):
        spark.range(h * m + s, h * m + s + 2).toDF("id").coalesce(1).write.parquet(str(tmp_path / f"w{h}{m}{s}"))
        part = next((tmp_path / f"w{h}{m}{s}").glob("part-*"))
        (tmp_path / f"tree/{h}/{m}/{s}").mkdir(parents=True)
        part.rename(tmp_path / f"tree/{h}/{m}/{s}/results.parquet")
        (tmp_path / f"tree/{h}/{m}/{s}/other.txt").write_text("no parquet")
    read = lambda **at: slices.read_tree(spark, str(tmp_path / "tree"), "results.parquet", **at)
    assert {tuple(r) for r in read().select("hour", "minute", "second").collect()} == {(19, 5, 0), (19, 42, 7), (3, 42, 59), (3, 5, 1)}
    assert {tuple(r)[1:] for r in read(hour=3).collect()} == {(3, 42, 59), (3, 5, 1)} and len(read(hour=3, minute=5).inputFiles()) == 1
    assert {tuple(r)[1:] for r in read(minute=42).collect()} == {(19, 42, 7), (3, 42, 59)}


def test_supertypes():
    t = T._parse_datatype_string
    held = [("int", "bigint", "bigint"), ("int", "float", "double"), ("bigint", "double", "double"), ("date", "timestamp", "timestamp"), ("string", "int", "string"), ("decimal(5,2)", "decimal(9,1)", "decimal(10,2)"),
            ("decimal(5,2)", "int", "double"), ("array<int>", "array<bigint>", "array<bigint>"), ("void", "int", "int"), ("boolean", "int", "string"), ("map<string,int>", "map<string,double>", "map<string,double>"),
            ("struct<a:int,b:string>", "struct<b:string,c:date,a:double>", "struct<a:double,b:string,c:date>"), ("struct<a:int>", "int", "string")]
    for a, b, want in held:
        assert slices.nullable(slices.supertype(t(a), t(b))) == slices.nullable(t(want))
        if "struct" not in a:
            assert slices.nullable(slices.supertype(t(b), t(a))) == slices.nullable(t(want))


def test_files_that_drift(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    put("a", [(1, 2, [1], (3,)), (None, None, None, None)], "id int, n int, l array<int>, s struct<x:int>")
    put("b", [("x", 2.5, [2**40], (2**40, "y"))], "id string, n double, l array<bigint>, s struct<x:bigint,y:string>")
    put("c", [((1, 2),)], "id struct<p:int,q:int>")
    put("d", [(9, 9)], "n bigint, more int")
    put("e", [(4, 5, [6], (7,))], "id int, n int, l array<int>, s struct<x:int>")
    out = slices.merge_slices(spark, [str(tmp_path / x) for x in "abcde"])
    assert out.columns == ["id", "n", "l", "s", "more"] and dict(out.dtypes)["s"] == "struct<x:bigint,y:string>"
    got = {str(tuple(r)) for r in out.collect()}
    S = lambda x, y=None: f"Row(x={x}, y={y!r})"
    assert got == {f"('1', 2.0, [1], {S(3)}, None)", "(None, None, None, None, None)", f"('x', 2.5, [{2**40}], {S(2**40, 'y')}, None)", "('{\"p\":1,\"q\":2}', None, None, None, None)",
                   "(None, 9.0, None, None, 9)", f"('4', 5.0, [6], {S(7)}, None)"}
    assert str(out._jdf.queryExecution().optimizedPlan()).count("Relation [") == 4  # a and e are read together
    with pytest.raises(ValueError, match="no slices"):
        slices.merge_slices(spark, [])


def test_states_of_pages(spark):
    from tidemark.functions import pages

    good = '{"itemInfo":{"itemStruct":{"id":7,"desc":"é \\" } ,\\"webapp"}}}'
    wrap = lambda x: f"<p>{pages.START}{x}{pages.END}null</p>{pages.END}"
    rows = [(1, wrap(good)), (2, wrap('{"statusCode":10222,"statusMsg":"x"}')), (3, wrap("{}")), (4, wrap('{"itemInfo":')), (5, f"{pages.START}{good}"), (6, f"{good}{pages.END}"), (7, ""), (8, None),
            (9, f"{pages.END}{wrap(good)}"), (10, wrap('{"statusCode":0,"itemInfo":{"itemStruct":{"id":8}}}')), (11, wrap(""))]
    got = {r["i"]: r["s"] for r in spark.createDataFrame(rows, "i int, t string").select("i", pages.state(F.col("t"), "id bigint, desc string").alias("s")).collect()}
    assert [(i, s["item"]["id"]) for i, s in got.items() if s["item"]] == [(1, 7), (9, 7), (10, 8)] and got[1]["item"]["desc"] == 'é " } ,"webapp'
    assert (got[2]["status_code"], got[2]["status_msg"], got[2]["error"]) == (10222, "x", None)
    assert {i: s["error"] for i, s in got.items() if s["error"]} == {3: pages.NO_ITEM, 4: pages.BROKEN, 5: pages.NO_STATE, 6: pages.NO_STATE, 7: pages.NO_STATE, 8: pages.NO_STATE, 11: pages.BROKEN}
