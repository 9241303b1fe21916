import datetime
import hashlib
import json
import math
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom import logs, sinks, sources, streaming
from dialoom.functions import ellipsis, fixed, jpeg
from dialoom.functions.similarity import ratio
from dialoom.operators import checkpoints, evaluate, infer, pipeline, ranking, skew, split, stats


def test_global_index_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "k int, i int")
    got = [(r.k, r.i) for r in ranking.with_global_index(df, ["k", "i"], "n").orderBy("n").collect()]
    assert got == sorted((i % 7, i) for i in range(500))
    assert [r.n for r in ranking.with_global_index(df, ["k", "i"], "n").orderBy("n").collect()] == list(range(500))
    assert ranking.with_global_index(df.limit(0), ["k", "i"]).count() == 0


@pytest.mark.parametrize("values", [[1, 2, 3, 10, 50], [4, 4, 4], [0], list(range(100)), []])
def test_histogram_like_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    got = [r.n for r in stats.equal_width_histogram(df, F.col("v")).orderBy("bin").collect()]
    assert got == (np.histogram(values, bins=50)[0].tolist() if values else [])


def test_top_k_like_counter(spark):
    values = list("bbaaccdz") * 3 + ["q"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = [(r.value, r.n) for r in stats.top_k(stats.value_counts(df, "v", ["i"]), 5).orderBy("rank").collect()]
    assert got == Counter(values).most_common(5)


def test_coverage_only_for_sizes_there_are(spark):
    df = spark.createDataFrame([(str(i % 150),) for i in range(1000)], "v string")
    got = {r.k: r.pct for r in stats.coverage(stats.value_counts(df, "v")).collect()}
    freq = sorted(Counter(i % 150 for i in range(1000)).values(), reverse=True)
    assert got == {100: sum(freq[:100]) / 1000 * 100}


def test_split_is_exact_and_disjoint(spark):
    df = spark.createDataFrame([(f"{i}_{i}",) for i in range(101)], "id string")
    rows = split.shuffle_split(df).collect()
    assert Counter(r.split for r in rows) == {"train": 90, "val": 11} and len({r.id for r in rows}) == 101
    assert split.split_summary(split.shuffle_split(df)).count() == 2


def test_the_cut_is_found_by_prefixes(spark, monkeypatch):
    monkeypatch.setattr(split, "FEW", 3)
    df = spark.createDataFrame([(f"{i}",) for i in range(2000)] + [(None,)], "id string")
    got = {r.id: r.split for r in split.shuffle_split(df, share=0.37, seed=5).collect()}
    order = sorted(map(str, range(2000)), key=lambda k: (hashlib.md5(f"5:{k}".encode()).hexdigest(), k))
    n = math.floor(2001 * 0.37)
    assert {k for k, v in got.items() if v == "train"} == set(order[:n])
    same = spark.createDataFrame([("a",)] * 20, "id string")  # equal keys share a side
    assert {r.split for r in split.shuffle_split(same).collect()} == {"val"}
    assert split.shuffle_split(df.limit(0)).count() == 0
    assert {r.split for r in split.shuffle_split(df, share=1.0).collect()} == {"train"}


def test_running_totals(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(3), r.randrange(9)) for i in range(-50, 300)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long, n long")
    got = {(x.a, x.b): x.before for x in ranking.running_total(df, ["a", "b"], "n", "before", partitions=7).collect()}
    start, want = 0, {}
    for a, b, n in sorted(rows):
        want[a, b] = start
        start += n
    assert got == want and ranking.running_total(df.limit(0), ["a", "b"], "n", "before").count() == 0


def test_lookup_of_a_hot_key(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else None if i % 2 else i) for i in range(300)], "i long, k long").withColumn("_x", F.array(F.lit(1)))
    got = {x.i: x.v for x in skew.lookup(rows, spark.createDataFrame([(7, "h"), (6, "s")], "k long, v string"), ["k"], "left").collect()}
    want = {i: "h" if i % 3 else None if i % 2 or i != 6 else "s" for i in range(300)}
    assert got == want
    table, hot = spark.createDataFrame([(7, "h"), (6, "s")], "k long, v string"), spark.createDataFrame([(7, 5)], "k long, parts int")
    assert {x.i: x.v for x in skew.lookup(rows, table, ["k"], "left", hot=hot).collect()} == want


def _answerer():
    def answer(image, question):
        if question == "bad":
            raise RuntimeError("no")
        return f"{image}|{question}"

    return answer


def test_evaluation_as_one_call(spark, tmp_path):
    turns = "conversations array<struct<`from`:string,value:string>>"
    rows = [(1, "a", "i.jpg", [("human", "<image>\nq "), ("gpt", " p/i.jpg|q")]), (2, "b", None, [("human", "bad"), ("gpt", "x")]), (3, "c", "j.jpg", [("gpt", "y")]), (4, "d", "k.jpg", None)]
    df = spark.createDataFrame(rows, f"row_id long, id string, image string, {turns}")
    found, report = pipeline.batch_evaluate(df, _answerer, str(tmp_path / "p.json"), "p/", "row_id")
    assert [(r.id, r.prediction) for r in found.orderBy("row_id").collect()] == [("a", "p/i.jpg|q"), ("c", "p/j.jpg|"), ("d", "p/k.jpg|")]
    r = report.first()
    assert (r.n_requested, r.n_scored, r.n_match) == (4, 3, 1)
    stored = json.loads((tmp_path / "p.json").read_text())
    assert [x["id"] for x in stored] == ["a", "c", "d"] and list(stored[0]) == ["id", "question", "ground_truth", "prediction"]
    pipeline.evaluate_model(df, _answerer, "checkpoint-1", 1, output=str(tmp_path / "r.json"), folder="p")
    stored = json.loads((tmp_path / "r.json").read_text())
    assert (stored["checkpoint"], stored["num_samples"], len(stored["results"])) == ("checkpoint-1", 1, 1) and list(stored["results"][0]) == ["id", "question", "ground_truth", "prediction", "exact_match", "similarity"]
    assert pipeline.evaluate_model(df.limit(0), _answerer, "c", -1).first().num_samples == 0
    assert pipeline.ask(spark, _answerer, "i", "q") == "i|q"
    with pytest.raises(RuntimeError):
        pipeline.ask(spark, _answerer, "i", "bad")
    assert pipeline.Decoding(0.0).sample is False and pipeline.Decoding().sample is True


def test_status_config_and_logging(spark, tmp_path):
    names = spark.createDataFrame([("checkpoint-500",), ("x",), ("checkpoint-1500",)], "name string")
    row = checkpoints.status_report({"train": names, "val": names.limit(0)}, names).first()
    assert (row.train, row.val, row.checkpoints) == (3, 0, ["checkpoint-1500", "checkpoint-500"])
    (tmp_path / "c.yaml").write_text("data:\n  data_dir: d\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            sources.load_config(str(tmp_path / "c.yaml"))
    else:
        assert sources.load_config(str(tmp_path / "c.yaml")) == {"data": {"data_dir": "d"}}
    with pytest.raises(Exception):  # noqa: B017
        sources.load_config(str(tmp_path / "none.yaml"))
    df = spark.createDataFrame([(1, "test"), (2, "val")], "i long, split string")
    df.write.parquet(str(tmp_path / "corpus"))
    assert [r.i for r in sources.corpus(spark, str(tmp_path / "corpus"), "test").collect()] == [1] and sources.row_at(df, 2, "i").count() == 1
    logs.setup(str(tmp_path / "log"))


def test_ratio_golden():
    assert ratio("tide", "diet") == 0.25 and ratio("diet", "tide") == 0.5
    assert ratio("Đây là chợ", "đây là khu chợ") == 0.8333333333333334 and ratio(None, "a") is None
    a, b = "x" * 250, "x" * 249 + "y"
    assert ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_reports_without_rows_and_with_nulls(spark):
    schema = "pred_id bigint, id string, question string, ground_truth string, prediction string, scored_at timestamp"
    rows = [(1, "a", "q", " x ", "x", None), (2, "b", "q", "x", None, None), (3, "c", "q", "x", "y", None)]
    scored = evaluate.scored(spark.createDataFrame(rows, schema), with_similarity=True)
    r = evaluate.exact_match_report(scored).first()
    assert (r.n_requested, r.n_scored, r.n_match, r.exact_match_pct) == (3, 2, 1, 50.0)
    assert evaluate.exact_match_report(scored, "requested").first().exact_match_pct == pytest.approx(100 / 3)
    report = evaluate.eval_report(scored, "checkpoint-500").first()
    assert report.num_samples == 2 and len(report.results) == 2
    none = evaluate.scored(spark.createDataFrame([], schema), with_similarity=True)
    assert evaluate.exact_match_report(none).first().exact_match_pct == 0.0
    assert evaluate.similarity_report(none).first().avg_similarity_pct == 0.0


def test_latest_checkpoint_both_ways(spark):
    names = spark.createDataFrame([("checkpoint-500",), ("checkpoint-1000",), ("checkpoint-1500",), ("x",)], "name string")
    assert checkpoints.latest(names).first().name == "checkpoint-500"
    assert checkpoints.latest(names, numeric=True).first().name == "checkpoint-1500"
    assert checkpoints.latest(names.where("name = 'x'")).first().name is None


def test_failing_rows_are_kept_apart(spark):
    def make():
        def answer(image, question):
            if question == "bad":
                raise ValueError("no")
            return question.upper()

        return answer

    df = spark.createDataFrame([("i", "a"), ("i", "bad")], "image string, question string")
    out = infer.batch_infer(df, make)
    assert [r.prediction for r in infer.succeeded(out).collect()] == ["A"]
    assert [r.error for r in infer.failed(out).collect()] == ["ValueError: no"]


def test_json_forms(spark, tmp_path):
    rows = [("1_0", "image_1.jpg", [("human", "<image>\nQ?"), ("gpt", None)]), ("2_1", None, [])]
    df = spark.createDataFrame(rows, "id string, image string, conversations array<struct<`from`:string,value:string>>")
    sinks.write_json_lines(df, str(tmp_path / "lines"))
    assert '"value":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "lines")).collect())
    assert sinks.write_json_array(df, str(tmp_path / "array.json")) == 2
    for path in ("lines", "array.json"):
        assert sorted(map(str, sources.records(spark, str(tmp_path / path)).collect())) == sorted(map(str, df.collect()))
    assert sources.sample_count(spark, str(tmp_path / "array.json")) == 2
    assert sinks.write_json_array(df.limit(0), str(tmp_path / "none.json")) == 0
    first, again = (sinks.prepare_once({"train": df, "val": df.limit(1)}, str(tmp_path / "once")) for _ in range(2))
    assert first == {"train": 2, "val": 1, "status": "prepared"} and again == {"train": 2, "val": 1, "status": "cached"}
    with pytest.raises(FileNotFoundError):
        sources.records(spark, str(tmp_path / "missing"))


def test_images_and_listing(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "id bigint, image binary")
    out = {r.id: r.image_ok for r in sinks.write_images(df, str(tmp_path / "img"), encoder=bytes).collect()}
    assert out == {1: True, 2: False}
    assert [bytes(r.content) for r in sources.images(spark, str(tmp_path / "img")).select("content").collect()] == [b"abc"]
    assert [r.name for r in sources.listing(spark, str(tmp_path / "img")).collect()] == ["image_1.jpg"]


def test_ellipsis(spark):
    got = [r.s for r in spark.createDataFrame([("a" * 81,), ("b",), (None,)], "v string").select(ellipsis("v").alias("s")).collect()]
    assert got == ["a" * 80 + "...", "b", None]


def test_fixed_digits_like_python(spark):
    values = [0.125, 2.675, -0.0, 1e15, 7.0, None, 0.5]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(fixed("v", 2, 6).alias("s")).collect()]
    assert got == [None if v is None else f"{v:6.2f}" for v in values]


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 5, 1, 10)
    rows = [(1, 1, 0, "user", "q", 1, t, t), (2, 1, 0, "user", "q", 1, t, t), (3, 1, 1, "gpt", "a", 1, t, t)]
    from dialoom import schemas

    spark.createDataFrame(rows, schemas.CONVERSATIONS).write.parquet(str(tmp_path / "in"))
    stream = streaming.turns_per_window(streaming.read_turns(spark, str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("turns").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.role, r.n) for r in spark.table("turns").collect()} == {("user", 2), ("gpt", 1)}
    once = streaming.first_deliveries(streaming.read_turns(spark, str(tmp_path / "in")))
    q = once.writeStream.outputMode("append").format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2


def _java(spark, data):
    j = spark._jvm
    image = j.javax.imageio.ImageIO.read(j.java.io.ByteArrayInputStream(bytearray(data)))
    px = np.array([[image.getRGB(x, y) for x in range(image.getWidth())] for y in range(image.getHeight())], np.int64)
    return np.stack([px >> 16 & 255, px >> 8 & 255, px & 255], 2)


def _java_written(spark, px, kind, layout):
    j = spark._jvm
    image = j.java.awt.image.BufferedImage(px.shape[1], px.shape[0], layout)
    for y, row in enumerate(px.tolist()):
        for x, (r, g, b) in enumerate(row):
            image.setRGB(x, y, -(1 << 24) | r << 16 | g << 8 | b)
    out = j.java.io.ByteArrayOutputStream()
    assert j.javax.imageio.ImageIO.write(image, kind, out)
    return bytes(out.toByteArray())


Y, X = np.mgrid[0:21, 0:27]
PICTURES = [np.stack([X * 9 % 256, Y * 12 % 256, X + Y], 2).astype(np.uint8), np.full((8, 8, 3), 200, np.uint8), np.array([[[255, 0, 0]]], np.uint8), np.random.default_rng(1).integers(90, 160, (19, 23, 3)).astype(np.uint8)]


@pytest.mark.parametrize("i", range(len(PICTURES)))
def test_jpeg_as_another_decoder_reads_it(spark, i):
    px = PICTURES[i]
    sizes = []
    for quality, most in ((100, 1.5), (95, 4), (50, 25)):
        data = jpeg.encode(px, quality)
        sizes.append(len(data))
        assert np.abs(_java(spark, data) - px).mean() <= most
    assert sizes == sorted(sizes, reverse=True)
    assert jpeg.to_jpeg(data) == data


@pytest.mark.parametrize("kind,layout", [("png", 1), ("png", 2), ("png", 13), ("bmp", 5)])
def test_pictures_as_another_encoder_wrote_them(spark, kind, layout):
    data = _java_written(spark, PICTURES[0], kind, layout)
    assert (jpeg.decode(data) == _java(spark, data)).all()


def test_netpbm_and_broken_pictures(spark, tmp_path):
    px = PICTURES[0]
    ppm = b"P6\n# x\n27 21\n255\n" + px.tobytes()
    assert (jpeg.decode(ppm) == px).all() and jpeg.decode(b"P5 2 1 255 ab").tolist() == [[[97] * 3, [98] * 3]]
    for bad in (b"", b"abc", b"\x89PNG\r\n\x1a\n", ppm[:-5], b"BM"):
        with pytest.raises(ValueError):
            jpeg.to_jpeg(bad)
    df = spark.createDataFrame([(1, bytearray(ppm)), (2, bytearray(b"abc")), (3, None)], "id bigint, image binary")
    assert {r.id: r.image_ok for r in sinks.write_images(df, str(tmp_path / "rgb")).collect()} == {1: True, 2: False, 3: False}
    stored = sources.images(spark, str(tmp_path / "rgb")).collect()
    assert len(stored) == 1 and np.abs(_java(spark, bytes(stored[0].content)) - px).mean() < 4
