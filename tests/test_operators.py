"""Edge cases on small literal frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderbox.config import Environment, RunConfig, first_of
from cinderbox.functions import expr as E
from cinderbox.functions import image as I
from cinderbox.operators import boxes, evolve, labels, metrics, runs, sample, selection
from cinderbox.plans import live
from cinderbox.sources import readers, sinks
from cinderbox.streaming import detections as stream

BOX = "frame_id long, cls int, pred_id long, conf double, x1 double, y1 double, x2 double, y2 double"


def frame(spark, rows):
    return spark.createDataFrame(rows, BOX)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_suppression_chain(spark):
    # A covers B, B covers C, A does not cover C: B goes, C stays
    df = frame(spark, [(1, 0, 1, .9, 0., 0., 10., 10.), (1, 0, 2, .8, 3., 0., 13., 10.), (1, 0, 3, .7, 6., 0., 16., 10.)])
    for f in (boxes.suppress, boxes.suppress_pandas):
        assert sorted(r.pred_id for r in f(df, ["frame_id", "cls"], "conf", "pred_id").collect()) == [1, 3]


def test_suppression_ties_and_empty_boxes(spark):
    df = frame(spark, [(1, 0, 2, .9, 0., 0., 10., 10.), (1, 0, 1, .9, 0., 0., 10., 10.), (1, 0, 3, .5, 5., 5., 5., 5.), (2, 0, 4, .5, 0., 0., 10., 10.)])
    for f in (boxes.suppress, boxes.suppress_pandas):
        assert sorted(r.pred_id for r in f(df, ["frame_id", "cls"], "conf", "pred_id").collect()) == [1, 3, 4]


def test_suppression_forms_agree(spark):
    random.seed(3)
    rows = [(random.randrange(4), random.randrange(2), i, random.random(), float(x := random.randrange(40)), float(y := random.randrange(40)), x + 20., y + 20.) for i in range(300)]
    got = [sorted(r.pred_id for r in f(frame(spark, rows), ["frame_id", "cls"], "conf", "pred_id").collect()) for f in (boxes.suppress, boxes.suppress_pandas)]
    assert got[0] == got[1] and 0 < len(got[0]) < 300


def test_threshold_is_strict(spark):
    df = frame(spark, [(1, 0, 1, .5, 0., 0., 1., 1.), (1, 0, 2, .51, 0., 0., 1., 1.)])
    assert [r.pred_id for r in boxes.above(df, "conf", .5).collect()] == [2]


def test_plan_keeps_empty_frames_and_raises_on_unknown_classes(spark):
    classes = spark.createDataFrame([(0, "fire"), (1, "smoke")], "cls int, name string")
    raw = frame(spark, [(1, 0, 1, .9, 0., 0., 10., 10.), (1, 1, 2, .6, 0., 0., 10., 10.), (2, 0, 3, .2, 0., 0., 10., 10.)])
    out = live.detect(raw, classes)
    frames = spark.createDataFrame([(1,), (2,), (3,)], "frame_id long")
    got = {r.frame_id: list(r.labels) for r in live.annotated(frames, out).collect()}
    assert got == {1: ["smoke 0.60", "fire 0.90"], 2: [], 3: []}
    with pytest.raises(Exception, match="no name for class"):
        live.detect(frame(spark, [(1, 7, 1, .9, 0., 0., 1., 1.)]), classes).collect()


def test_across_classes(spark):
    classes = spark.createDataFrame([(0, "fire"), (1, "smoke")], "cls int, name string")
    raw = frame(spark, [(1, 0, 1, .9, 0., 0., 10., 10.), (1, 1, 2, .6, 0., 0., 10., 10.)])
    assert [r.name for r in live.detect(raw, classes, across_classes=True).collect()] == ["fire"]


def test_half_even(spark):
    for x, want in ((0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0)):
        assert one(spark, F.bround(F.lit(x))) == want
    assert one(spark, E.accumulate_steps(16)) == 4 and one(spark, E.accumulate_steps(128)) == 1
    assert one(spark, E.label_text(F.lit("a"), F.lit(0.125))) == "a 0.12"


def test_labels_round_like_their_sql(spark):
    got = {x: one(spark, E.label_text(F.lit("a"), F.lit(x))) for x in (0.545, 0.575, 1.015, 1.035, 0.505, 0.515, 0.9, float("nan"), float("inf"))}
    assert got == {x: "a " + t for x, t in zip(got, ("0.55", "0.57", "1.01", "1.03", "0.50", "0.52", "0.90", "nan", "inf"))}


def test_warmup_edge_is_inside(spark):
    at = lambda n: one(spark, E.warmup_rate(F.lit(n), F.lit(0), 100, 0.1, 0.01, F.lit(0.5)))
    assert at(0) == pytest.approx(0.1) and at(100) == pytest.approx(0.005) and at(101) == pytest.approx(0.005)


def test_maps(spark):
    m = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0))
    assert one(spark, E.map_update(m, F.create_map(F.lit("b"), F.lit(5.0)))) == {"a": 1.0, "b": 5.0}
    assert one(spark, E.map_without(m, ["a"])) == {"b": 2.0}
    assert one(spark, E.map_vector(m, ["b", "a"])) == [2.0, 1.0]
    with pytest.raises(Exception, match="missing key"):
        one(spark, E.map_vector(m, ["c"]))


def test_elite_ties_and_nan(spark):
    df = spark.createDataFrame(list(enumerate([.1, .5, .5, .9, .5, .2, math.nan])), "idx int, f double")
    assert sorted(r.idx for r in selection.elite(df, "f", 2).collect()) == [1, 2, 3, 4]
    assert selection.elite(df.limit(0), "f", 2).count() == 0
    assert selection.first_best(df, "f", "idx").first().idx == 3


def test_best_epoch_latest_of_equals(spark):
    df = spark.createDataFrame([("r", 3, .7), ("r", 7, .7), ("r", 8, .1), ("r", 9, math.nan)], "run string, epoch int, f double")
    assert runs.best_row(df, ["run"], "f", "epoch", []).first().epoch == 7


def test_early_stop(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([.1, .5, .5, .4, .4, .4, .6])], "run string, epoch0 int, f double")
    r = runs.early_stop(df, ["run"], ["epoch0"], "f", 3).first()
    assert (r.stop, r.last_best) == (5, 2)


def test_step_trigger_like_a_loop(spark):
    last, fires = -1, 0
    for ni in range(57):
        acc = max(1, round(np.interp(ni, [0, 20], [1, 64 / 16]))) if ni <= 20 else 4
        if ni - last >= acc:
            last, fires = ni, fires + 1
    r = runs.step_trigger(spark.createDataFrame([("r", 57)], "run string, n long"), ["run"], "n", 20, 16).first()
    assert (r.fires, r.last_fire) == (fires, last)


def test_labels(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "cls int")
    w = {r.cls: (r["count"], r.weight) for r in labels.class_weights(df, 4).collect()}
    assert w[1][0] == 0 and math.isfinite(w[1][1]) and sum(x for _, x in w.values()) == pytest.approx(1)
    assert not labels.label_range(df, 2).first().ok and labels.label_range(df, 3).first().ok
    with pytest.raises(Exception, match="out of range"):
        labels.require_range(df, 2).collect()


def test_prefix_sums_over_blocks(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(1000)], "k long, v long")
    got = {r.k: r.s for r in sample.prefix_sums(df, "k", "v", "s", blocks=5).collect()}
    assert got == dict(enumerate(np.cumsum([i % 5 for i in range(1000)]).tolist()))


def test_average_precision_by_hand(spark):
    df = spark.createDataFrame([("a", 1, .9, True), ("a", 2, .8, False), ("a", 3, .7, True)], "cls string, id int, conf double, hit boolean")
    truths = spark.createDataFrame([("a", 2)], "cls string, truths long")
    ap = metrics.average_precision(df, ["cls"], "conf", "id", "hit", truths)
    assert ap.first().ap == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.mean_ap(ap).first().map == pytest.approx((1 + 2 / 3) / 2)


def test_search_improves_and_repeats(spark):
    score = lambda p: p.withColumn("fitness", -F.abs(F.col("genes")[0] - 0.5) - F.abs(F.col("genes")[1] - 0.5))
    run = lambda: evolve.search(spark, score, 4, seeds=[[0.0, 0.0]], seed=2, population=12, lo=[0.0, 0.0], hi=[1.0, 1.0])[1]
    genes, fitness = run()
    assert run() == (genes, fitness) and fitness > -1.0 and all(0 <= g <= 1 for g in genes)
    assert score(spark.createDataFrame([(0, genes)], "idx int, genes array<double>")).first().fitness == fitness


def test_search_sizes():
    assert [evolve.elite_size(g, 300) for g in (0, 150, 299)] == [2, 3, 4]
    assert [evolve.tournament_size(g, 300) for g in (0, 150, 299)] == [10, 5, 2]
    assert sum(g[1] for g in evolve.GENES) == 13 and len(evolve.GENES) == 29


def test_images(spark):
    im = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    df = spark.createDataFrame([(bytearray(im.tobytes()), 2, 4, 3, [(0., 0., 1., 1., 9., 8., 7.)])], "data binary, height int, width int, n_channels int, b array<struct<x1:double,y1:double,x2:double,y2:double,r:double,g:double,b:double>>")
    t = df.select(I.to_tensor("data", "height", "width", "n_channels").alias("t")).first().t
    assert np.allclose(t, (im[:, :, ::-1].transpose(2, 0, 1) / 255).ravel(), atol=1e-7)
    drawn = np.frombuffer(bytes(df.select(I.boxes_drawn("data", "height", "width", "n_channels", "b").alias("d")).first().d), np.uint8).reshape(2, 4, 3)
    assert drawn[0, 0].tolist() == [7, 8, 9] and drawn[0, 3].tolist() == im[0, 3].tolist()
    assert np.allclose(I.bilinear(np.arange(16.).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])


def test_plug_in_model(spark):
    spark.dataSource.register(readers.FrameSource)
    frames = spark.read.format("frames").options(width="8", height="4", frames="3").load()

    def make():
        import numpy as np

        return lambda x: np.array([[0., 0., 4., 4., .9, 1.] for _ in range(len(x))])

    out = live.inferred(frames, make, (3, 4, 8), batch_size=2)
    assert sorted((r.frame_id, r.cls, r.conf) for r in out.collect()) == [(0, 1, .9), (1, 1, .9), (2, 1, .9)]


def test_stream_equals_batch_and_errors_surface(spark, tmp_path):
    spark.dataSource.register(readers.FrameSource)
    source = lambda **o: spark.readStream.format("frames").options(width="4", height="2", frames="12", **o).load()
    got = stream.run_batches(source(), lambda b: b.select("frame_id", "width"), f"file://{tmp_path}/a")
    assert sorted(r.frame_id for r in got.collect()) == list(range(12))
    with pytest.raises(Exception, match="cannot be read"):
        stream.run_batches(source(fail_at="7"), lambda b: b.select("frame_id"), f"file://{tmp_path}/b").collect()


def test_hooks():
    hooks, seen = stream.Hooks(), []
    hooks.register("on_train_batch_end", lambda n: seen.append(n) or n < 2)
    for n in range(3):
        hooks.run("on_train_batch_end", n)
    assert seen == [0, 1, 2] and hooks.stop
    with pytest.raises(ValueError):
        hooks.register("on_nothing", print)


def test_state_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("r", f"2024-01-01 00:00:0{i}", v) for i, v in enumerate([.1, .5, .4, .4, .6])], "run string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/m")
    s = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/m")
    q = stream.best_so_far_stream(s, "run", "v", "ts", 2).writeStream.format("memory").queryName("best_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.best, r.stop) for r in spark.table("best_rows").orderBy("ts").collect()]
    assert got == [(.1, False), (.5, False), (.5, False), (.5, True), (.6, False)]


def test_files(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "b.yaml").write_text("lr0: 0.01  # rate\nname: x\n")
    (tmp_path / "h" / "a.yaml").write_bytes(b"lr0: 0.02\nbad: \xff1\n")
    assert readers.hyperparameters(spark, f"{tmp_path}/h/b.yaml") == {"lr0": 0.01, "name": "x"}
    assert readers.hyperparameters(spark, {"a": 1}) == {"a": 1}
    assert [r.entries["lr0"] for r in readers.map_files(spark, f"{tmp_path}/h").collect()] == ["0.02", "0.01"]
    assert readers.population_seeds(spark, f"{tmp_path}/h", ["lr0"]) == [[0.02], [0.01]]
    assert readers.parse_map("g0:\n  a: 1\n  b: 2.5\nn: [1, 2]\n") == {"g0": {"a": 1, "b": 2.5}, "n": [1, 2]}
    assert readers.latest(spark, f"{tmp_path}/h", "*.yaml").endswith(".yaml")
    d = readers.dataset(spark, {"train": "t", "val": "v", "names": ["fire", "smoke"]})
    assert d["nc"] == 2 and [r.name for r in readers.class_table(spark, d["names"]).collect()] == ["fire", "smoke"]
    with pytest.raises(ValueError):
        readers.dataset(spark, {"train": "t", "val": "v", "nc": 3, "names": ["a"]})


def test_sinks(spark, tmp_path):
    state = spark.createDataFrame([("r", 1, .5, b"x")], "run string, epoch int, best double, optimizer binary")
    assert sinks.save_checkpoint(state, f"{tmp_path}/c", 10, True, 5) == ["last", "best", "epoch=10"]
    assert sinks.save_checkpoint(state, f"{tmp_path}/c", 11, False, 5) == ["last"]
    assert "optimizer" not in sinks.stripped(spark, f"{tmp_path}/c/best", f"{tmp_path}/s", ["optimizer"]).columns
    (tmp_path / "exp").mkdir()
    assert sinks.run_folder(spark, f"{tmp_path}/exp") == f"{tmp_path}/exp2"
    assert sinks.run_folder(spark, f"{tmp_path}/exp", True) == f"{tmp_path}/exp"
    pop = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "idx int, genes array<double>")
    assert not sinks.save_population(pop, f"{tmp_path}/p", 0, ["a", "b"]) and sinks.save_population(pop, f"{tmp_path}/p", 1, ["a", "b"])
    assert sinks.population_map(pop, 1, ["a", "b"]).first().population["gen1number1"] == {"a": 3.0, "b": 4.0}
    for _ in range(2):
        sinks.append_csv(state.select("run", "epoch"), f"{tmp_path}/log")
    assert spark.read.option("header", True).csv(f"{tmp_path}/log").count() == 2
    det = spark.createDataFrame([(1, 2, .123456, 0., 1., 5., 4.)], "frame_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double")
    sinks.detections_json(det, f"{tmp_path}/d")
    assert spark.read.json(f"{tmp_path}/d").first().bbox == [0., 1., 5., 3.]


def test_options(spark):
    c = RunConfig(weights="w.pt", bucket="")
    assert c.bucket is None and c.with_options(epochs=3).epochs == 3 and len(c.frame(spark).columns) == 42
    with pytest.raises(TypeError):
        c.with_options(nonsense=1)
    with pytest.raises(ValueError):
        c.with_options(batch_size=15).check(Environment(0, 0, 2))
    assert c.with_options(evolve=3).named().project == "runs/evolve"
    assert first_of(None, {"a": 1}) == {"a": 1}
