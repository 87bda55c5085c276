"""Queries that go through sources and sinks, options, the plug-in model and the search, and their SQL.

What a sink writes is read back, so each result shows both. Files lie in work
folders of the shared folder that the session names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cinderbox.config import Environment, RunConfig, first_of
from cinderbox.functions import expr as E
from cinderbox.functions import image as I
from cinderbox.operators import boxes, metrics
from cinderbox.operators import evolve as ga
from cinderbox.operators.labels import concatenated
from cinderbox.plans import live
from cinderbox.queries import _BOXES, _U, ORACLE_SQL, events_as_boxes, query, table, work_folder
from cinderbox.sources import readers, sinks
from cinderbox.streaming.detections import Hooks, run_batches


# ---------------------------------------------------------------- frames and the plug-in model

def _frames(spark, sf_dir, width: int, height: int):
    """As many synthetic frames as there are nations."""
    spark.dataSource.register(readers.FrameSource)
    n = table(spark, sf_dir, "nation").count()
    return spark.read.format("frames").options(width=width, height=height, frames=n).load()


@query("SELECT n_nationkey::BIGINT AS frame_id, 48 AS height, 64 AS width, 3 AS n_channels, 9216 AS bytes, 40 * n_nationkey::BIGINT AS ms FROM nation")
def frame_source(spark, sf_dir):
    f = _frames(spark, sf_dir, 64, 48)
    return f.select("frame_id", "height", "width", "n_channels", F.octet_length("data").alias("bytes"), (F.unix_millis("ts") - F.unix_millis(F.lit("2000-01-01").cast("timestamp"))).alias("ms"))


@query("""WITH f AS (SELECT n_nationkey::BIGINT AS frame_id, (i // 48)::INT AS y, (i // 3 % 16)::INT AS x, (i % 3)::INT AS c, i::INT AS pos FROM nation, range(576) r(i)),
b AS (SELECT *, frame_id % 8 AS x1, frame_id % 8 + 6 AS x2 FROM f)
SELECT frame_id, pos, CASE WHEN (y IN (2, 9) AND x BETWEEN x1 AND x2) OR (x IN (x1, x2) AND y BETWEEN 2 AND 9) THEN [7, 8, 9][c + 1] ELSE (frame_id + x * 3 + c) % 256 END::INT AS value FROM b""")
def drawn_frames(spark, sf_dir):
    """A box of colour (9, 8, 7) in red, green, blue on each frame, byte by byte."""
    f = _frames(spark, sf_dir, 16, 12)
    x1 = (F.col("frame_id") % 8).cast("int")
    box = F.struct(x1.alias("x1"), F.lit(2).alias("y1"), (x1 + 6).alias("x2"), F.lit(9).alias("y2"), F.lit(9).alias("r"), F.lit(8).alias("g"), F.lit(7).alias("b"))
    f = f.withColumn("drawn", I.boxes_drawn("data", "height", "width", "n_channels", F.array(box)))
    return f.select("frame_id", F.posexplode(F.split(F.regexp_replace(F.hex("drawn"), "(..)(?=.)", "$1,"), ",")).alias("pos", "h")).select(
        "frame_id", "pos", F.conv("h", 16, 10).cast("int").alias("value"))


@query(ORACLE_SQL["frame_source"])
def frame_stream(spark, sf_dir):
    """The same frames as a stream, read until its end and released."""
    spark.dataSource.register(readers.FrameSource)
    n = table(spark, sf_dir, "nation").count()
    frames = spark.readStream.format("frames").options(width=64, height=48, frames=n, per_batch=10).load()
    plan = lambda f: f.select("frame_id", "height", "width", "n_channels", F.octet_length("data").alias("bytes"), (F.unix_millis("ts") - F.unix_millis(F.lit("2000-01-01").cast("timestamp"))).alias("ms"))
    return run_batches(frames, plan, work_folder(spark, "frames"))


def _corner_model():
    """Stands in for a trained model: two boxes a frame, whose confidences are its first pixel's red and green."""
    def predict(x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array([1, 2, 11, 22, 0, 0, 30, 30, 40, 40, 0, 1], np.float64), (len(x), 1))
        out[:, 4], out[:, 10] = x[:, 0, 0, 0], x[:, 1, 0, 0]
        return out

    return predict


@query("""WITH f AS (SELECT n_nationkey::BIGINT AS frame_id, (n_nationkey + 2) % 256 / 255.0 AS r, (n_nationkey + 1) % 256 / 255.0 AS g FROM nation)
SELECT frame_id, 0 AS pred_id, 0 AS cls, round(r::DOUBLE, 6) AS conf, 1.0::DOUBLE AS x1, 22.0::DOUBLE AS y2 FROM f UNION ALL SELECT frame_id, 1, 1, round(g::DOUBLE, 6), 30.0, 40.0 FROM f""")
def plug_in_model(spark, sf_dir):
    raw = live.inferred(_frames(spark, sf_dir, 64, 48), _corner_model, (3, 48, 64), batch_size=4)
    return raw.select("frame_id", "pred_id", "cls", F.round("conf", 6).alias("conf"), "x1", "y2")


@query("SELECT p_partkey, CASE WHEN p_size = 40 THEN 40 ELSE 64 END::BIGINT AS scaled, (p_size // 7)::BIGINT AS whole, (p_size % 7)::BIGINT AS rest FROM part")
def scaled_sides(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", E.scaled_shape(s, 40, 32).alias("scaled"), F.floor(s / 7).alias("whole"), (s % 7).cast("long").alias("rest"))


# ---------------------------------------------------------------- files

@query("""WITH i AS (SELECT n_nationkey AS k, length(n_name) AS length FROM nation), b AS (SELECT s_nationkey AS k, count(*) AS n, sum(s_suppkey) AS total FROM supplier GROUP BY s_nationkey)
SELECT k::INT AS k, length::BIGINT AS length, coalesce(n, 0)::INT AS boxes, coalesce(total, 0)::DOUBLE AS total FROM i LEFT JOIN b USING (k)""")
def image_loader(spark, sf_dir):
    """Nations as image files, their suppliers as boxes of the label file of the same stem."""
    folder = work_folder(spark, "images")
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    # one file for each key: its name is that of the folder
    n.select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")).repartition("k").write.partitionBy("k").option("lineSep", "\n").text(f"{folder}/images")
    line = F.concat_ws(" ", F.lit("1"), F.col("s_suppkey").cast("string"), F.lit("0.5 0.25 0.125"))
    s.select(line.alias("value"), F.col("s_nationkey").alias("k")).repartition("k").write.partitionBy("k").text(f"{folder}/labels")
    found = readers.labelled_images(spark, f"{folder}/images", f"{folder}/labels", "*.txt", "*.txt", by_folder=True)
    total = F.aggregate("boxes", F.lit(0.0), lambda acc, b: acc + b.x)
    return found.select(F.regexp_extract("stem", r"k=(\d+)", 1).cast("int").alias("k"), (F.col("length") - 1).alias("length"), F.size("boxes").alias("boxes"), total.alias("total"))


@query("""WITH o AS (SELECT p_partkey, p_size, (p_partkey % 9 + 1)::DOUBLE / (p_size % 5 + 1) AS ratio FROM part),
n AS (SELECT *, (row_number() OVER (ORDER BY ratio, p_partkey) - 1) // 16 AS batch FROM o), s AS (SELECT batch, min(ratio) AS lo, max(ratio) AS hi FROM n GROUP BY batch)
SELECT p_partkey, batch::BIGINT AS batch, (ceil(CASE WHEN hi < 1 THEN hi ELSE 1 END * 640 / 32) * 32)::BIGINT AS batch_height, (ceil(CASE WHEN lo > 1 THEN 1 / lo ELSE 1 END * 640 / 32) * 32)::BIGINT AS batch_width FROM n JOIN s USING (batch)""")
def rectangle_batches(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 9 + 1).cast("double").alias("h"), (F.col("p_size") % 5 + 1).cast("double").alias("w"))
    return readers.rectangles(p, "h", "w", 640, 16, "p_partkey").select("p_partkey", "batch", "batch_height", "batch_width")


@query("SELECT p_partkey, p_size FROM part")
def options_file(spark, sf_dir):
    """Options written as JSON and read back; a second write in a search leaves them as they are."""
    folder, rows = work_folder(spark, "options"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    sinks.save_options(rows, folder, "opt.json")
    sinks.save_options(rows.limit(0), folder, "opt.json", evolve=True)
    return spark.read.schema(rows.schema).json(f"{folder}/opt.json")


@query("SELECT n_nationkey::INT AS k, (n_nationkey * 0.5)::DOUBLE AS lr0, 'n' || n_nationkey AS name FROM nation")
def map_files(spark, sf_dir):
    """A file of ``key: value`` lines for each nation, read in bulk."""
    folder = work_folder(spark, "maps")
    text = F.concat(F.lit("# a comment\nlr0: "), (F.col("n_nationkey") * 0.5).cast("string"), F.lit("  # rate\nname: n"), F.col("n_nationkey").cast("string"))
    table(spark, sf_dir, "nation").select(text.alias("value"), F.col("n_nationkey").alias("k")).repartition("k").write.partitionBy("k").text(folder)
    m = readers.map_files(spark, folder, "*.txt")
    return m.select(F.regexp_extract("path", r"k=(\d+)", 1).cast("int").alias("k"), m.entries["lr0"].cast("double").alias("lr0"), m.entries["name"].alias("name"))


@query("SELECT * FROM (VALUES ('lr0', '0.01'), ('anchors', '[3.0, 4.0]'), ('flag', 'True'), ('none', 'None'), ('inner', '{''a'': 1, ''b'': ''x y''}')) t(key, value)")
def hyperparameter_file(spark, sf_dir):
    """A nested map written as text and read as a path; given as a map it is taken as it is."""
    folder = work_folder(spark, "hyp")
    text = "# rates\nlr0: 0.01\nanchors: [3.0, 4.0]\nflag: true  # on\nnone: null\ninner:\n  a: 1\n  b: 'x y'"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder)
    read = readers.hyperparameters(spark, f"{folder}/*.txt")
    given = readers.hyperparameters(spark, read)
    return spark.createDataFrame([(k, str(v)) for k, v in given.items()], "key string, value string")


@query("SELECT n_nationkey::INT AS cls, n_name AS name, 25 AS nc, 'item' AS single FROM nation")
def dataset_descriptor(spark, sf_dir):
    names = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # class names of a dataset: 25
    d = readers.dataset(spark, {"train": "a", "val": "b", "names": names})
    one = readers.dataset(spark, {"train": "a", "val": "b", "names": names}, single_class=True)
    return readers.class_table(spark, d["names"]).select("cls", "name", F.lit(d["nc"]).alias("nc"), F.lit(one["names"][0]).alias("single"))


@query("SELECT n_nationkey::INT AS idx, (unnest(range(3)))::INT AS pos, unnest([n_nationkey::DOUBLE, n_regionkey::DOUBLE, 0.5::DOUBLE]) AS value FROM nation")
def population_dump(spark, sf_dir):
    """Individuals written by generation and number, read back by their names; nothing is written before generation 1."""
    folder, names = work_folder(spark, "population"), ["a", "b", "c"]
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("idx"), F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"), F.lit(0.5)).alias("genes"))
    assert not sinks.save_population(p.limit(0), folder, 0, names) and sinks.save_population(p, folder, 7, names)
    found = spark.read.schema("population map<string,map<string,double>>").json(folder).select(F.explode("population").alias("name", "genes"))
    x = found.select(F.regexp_extract("name", r"^gen7number(\d+)$", 1).cast("int").alias("idx"), E.map_vector(F.col("genes"), names).alias("v"))
    return concatenated(x, "v", ["idx"])


@query("SELECT p_partkey, p_size, run FROM part, (VALUES (1), (2)) t(run)")
def results_log(spark, sf_dir):
    """Rows of two runs appended to one CSV log."""
    path, p = work_folder(spark, "results"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    for run in (1, 2):
        sinks.append_csv(p.withColumn("run", F.lit(run)), path)
    return spark.read.schema(p.withColumn("run", F.lit(1)).schema).option("header", True).csv(path)


@query("SELECT event_id, user_id, value FROM events")
def ndjson_log(spark, sf_dir):
    path, e = work_folder(spark, "ndjson"), table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    sinks.ndjson(e.where("event_id % 2 = 0"), path)
    sinks.ndjson(e.where("event_id % 2 = 1"), path)
    return spark.read.schema(e.schema).json(path)


@query(f"WITH {_BOXES} SELECT frame_id AS image_id, cls AS category_id, x1::DOUBLE AS x, y1::DOUBLE AS y, 40.0::DOUBLE AS w, 40.0::DOUBLE AS h, round(conf, 2) AS score FROM b")
def detections_file(spark, sf_dir):
    path = work_folder(spark, "detections")
    sinks.detections_json(events_as_boxes(spark, sf_dir), path)
    d = spark.read.schema("image_id long, category_id string, bbox array<double>, score double").json(path)
    return d.select("image_id", "category_id", *[F.get("bbox", i).alias(n) for i, n in enumerate("xywh")], F.round("score", 2).alias("score"))


@query("SELECT p_partkey, p_size, 'last' AS role FROM part UNION ALL SELECT p_partkey, p_size, 'best' FROM part UNION ALL SELECT p_partkey, p_size + 10, 'epoch=10' FROM part")
def checkpoint_files(spark, sf_dir):
    """Three epochs written by role: an earlier one was best, the last is overwritten, the tenth is periodic; read without a column."""
    folder, p = work_folder(spark, "checkpoints"), table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit(0.5).alias("optimizer"))
    written = [sinks.save_checkpoint(p.withColumn("p_size", F.col("p_size") + e), folder, e, best, period=10) for e, best in ((9, True), (10, False))]
    written.append(sinks.save_checkpoint(p, folder, 11, True, period=10))
    out = None
    for name in dict.fromkeys(n for names in written for n in names):
        x = sinks.stripped(spark, f"{folder}/{name}", f"{folder}-stripped/{name}", ["optimizer"]).withColumn("role", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT * FROM (VALUES (1, 'exp'), (2, 'exp2'), (3, 'exp3'), (4, 'exp')) t(n, name)")
def run_folders(spark, sf_dir):
    base, out = work_folder(spark, "runs"), []
    for n in (1, 2, 3, 4):
        path = sinks.run_folder(spark, f"{base}/exp", exist_ok=n == 4)
        spark.range(1).write.mode("append").parquet(path)
        out.append((n, path.rsplit("/", 1)[-1]))
    return spark.createDataFrame(out, "n int, name string")


@query("SELECT 'last-2' AS folder, true AS found")
def latest_run(spark, sf_dir):
    base = work_folder(spark, "latest")
    for n in (1, 2):
        spark.range(1).select(F.col("id").cast("string").alias("value")).coalesce(1).write.text(f"{base}/last-{n}")
    path = readers.latest(spark, base, "part-*")
    return spark.createDataFrame([(path.rsplit("/", 2)[-2], path.startswith("file:") or "://" in path)], "folder string, found boolean")


@query("SELECT b.idx, p.pos, p.value FROM (VALUES (0, 2.0), (1, 1.0), (2, 0.0)) b(idx, f), (SELECT (unnest(range(2)))::INT AS pos, unnest([0.5, 1.5])::DOUBLE AS base) q(pos, base), LATERAL (SELECT q.pos, (b.f + q.base)::DOUBLE AS value) p")
def population_files(spark, sf_dir):
    """Seeds of a search from a folder of files, the last read first."""
    folder = work_folder(spark, "seeds")
    rows = spark.createDataFrame([(k, f"a: {k + 0.5}\nb: {k + 1.5}") for k in range(3)], "k int, value string")
    rows.repartition("k").write.partitionBy("k").text(folder)
    seeds = readers.population_seeds(spark, folder, ["a", "b"], "*.txt")
    p = ga.initial(spark, [0.0, 0.0], [1.0, 1.0], seeds, 0, 3)
    return concatenated(p.select("idx", "genes"), "genes", ["idx"])


# ---------------------------------------------------------------- options and hooks

@query("SELECT * FROM (VALUES (0, 'runs/train', 'exp', 'SGD', 'True'), (1, 'runs/evolve', 'exp', 'Adam', 'False'), (2, 'runs/train', 'small', 'AdamW', 'False'), (3, 'other', 'exp', 'SGD', 'False')) t(n, project, name, optimizer, resume)")
def run_options(spark, sf_dir):
    base = RunConfig(weights="w.pt")
    given = [{"resume": True}, {"evolve": 300, "resume": True, "optimizer": "Adam"}, {"cfg": "models/small.yaml", "name": "cfg", "optimizer": "AdamW"}, {"project": "other"}]
    out = None
    for n, options in enumerate(given):
        x = base.with_options(**options).named().frame(spark).select(F.lit(n).alias("n"), "project", "name", "optimizer", "resume")
        out = x if out is None else out.unionByName(x)
    return out


def _refused(make) -> bool:
    try:
        make()
    except (ValueError, TypeError, FileNotFoundError):
        return True
    return False


@query("SELECT * FROM (VALUES ('unknown option', true), ('no model', true), ('optimizer', true), ('batch on processes', true), ('evolve on processes', true), ('first', true), ('second', false), ('alone', true), ('own file', true), ('no options', true), ('plain', false)) t(name, value)")
def option_checks(spark, sf_dir):
    alone, two = Environment(-1, -1, 1), Environment(1, 1, 2)
    base = RunConfig(weights="w.pt")
    found = [("unknown option", _refused(lambda: base.with_options(epoch=3))), ("no model", _refused(lambda: RunConfig().check(alone))),
             ("optimizer", _refused(lambda: RunConfig(optimizer="none"))), ("batch on processes", _refused(lambda: base.with_options(batch_size=3).check(two))),
             ("evolve on processes", _refused(lambda: base.with_options(evolve=3).check(two))), ("first", Environment(0, 0, 2).first), ("second", two.first), ("alone", alone.first),
             ("own file", first_of({"a": 1}, {"a": 2}) == {"a": 1} and first_of(None, {"a": 2}) == {"a": 2}), ("no options", _refused(lambda: first_of(None, None))), ("plain", _refused(lambda: base.check(two)))]
    return spark.createDataFrame(found, "name string, value boolean")


@query("SELECT r_regionkey::INT AS n, r_regionkey <= 2 AS ran, r_regionkey > 2 AS stopped FROM region")
def hook_stops(spark, sf_dir):
    """Batches run until an action on the end of one asks to stop."""
    hooks, seen = Hooks(), []
    hooks.register("on_train_batch_end", lambda n: seen.append(n) or n < 2)
    keys = [r.r_regionkey for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five rows
    stopped = []
    for k in keys:
        stopped.append(hooks.stop)
        if not hooks.stop:
            hooks.run("on_train_batch_end", k)
    return spark.createDataFrame([(k, k in seen, s) for k, s in zip(keys, stopped, strict=True)], "n int, ran boolean, stopped boolean")


# ---------------------------------------------------------------- validation

_MATCHED = ORACLE_SQL["det_match"]


@query(f"""WITH matched AS ({_MATCHED}), e AS (SELECT event_type AS cls, event_id, value FROM events WHERE value > 50),
t AS (SELECT (10 + i) / 20.0 AS least FROM range(10) r(i)), truths AS (SELECT cls, count(*) AS truths FROM e GROUP BY cls),
p AS (SELECT cls, event_id, value, least::DOUBLE AS least, coalesce(iou >= least::DOUBLE, false) AS hit FROM e JOIN matched ON pred_id = event_id, t),
r AS (SELECT *, sum(hit::INT) OVER w AS tp, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY cls, least ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, max(tp / n) OVER (PARTITION BY cls, least ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS e FROM r)
SELECT cls, least, count(*) AS predictions, any_value(truths) AS truths, round(sum(CASE WHEN hit THEN e::DECIMAL(28,18) ELSE 0 END)::DOUBLE / any_value(truths), 9) AS ap
FROM v JOIN truths USING (cls) GROUP BY cls, least""")
def average_precision_by_overlap(spark, sf_dir):
    """Predictions matched with truths of the same frame and class, scored at overlaps from 0.5 to 0.95."""
    x = events_as_boxes(spark, sf_dir)
    t = x.select("frame_id", "cls", F.col("event_id").alias("truth_id"), ((F.col("event_id") * 41) % 60).alias("x1"), ((F.col("event_id") * 43) % 60).alias("y1"))
    t = t.withColumns({"x2": F.col("x1") + 40, "y2": F.col("y1") + 40})
    matched = boxes.match(x.withColumnRenamed("event_id", "pred_id"), t, ["frame_id", "cls"], cell=50)
    truths = t.groupBy("cls").agg(F.count(F.lit(1)).alias("truths"))
    return metrics.average_precisions(matched.select("cls", "conf", "pred_id", "iou"), "cls", "conf", "pred_id", truths)


@query(f"""WITH ap AS ({ORACLE_SQL['average_precision_by_overlap']}) SELECT round((sum(CASE WHEN least = 0.5 THEN ap::DECIMAL(28,12) END))::DOUBLE / count(CASE WHEN least = 0.5 THEN 1 END), 9) AS map50,
  round((sum(ap::DECIMAL(28,12)))::DOUBLE / count(*), 9) AS map, count(DISTINCT cls) AS classes FROM ap""")
def validation_scores(spark, sf_dir):
    return metrics.validation(average_precision_by_overlap(spark, sf_dir))


# ---------------------------------------------------------------- search

_POP, _G, _N = 25, 30, 300
_LO, _HI = [0.0, 0.0, 0.0], [30.0, 5.0, 1.0]


def _individuals(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("int").alias("idx"), F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"), F.lit(0.5)).alias("genes"),
                    (F.col("n_regionkey") + F.col("n_nationkey") % 4).cast("double").alias("fitness"))


@query(f"""WITH g AS (SELECT n_nationkey::INT AS idx, pos::INT AS pos, ({_U.format("'4:start:' || n_nationkey || ':' || pos")})::DOUBLE AS u FROM nation, range(3) r(pos))
SELECT idx, pos, round([{', '.join(map(str, _LO))}][pos + 1]::DOUBLE + u * ([{', '.join(map(str, _HI))}][pos + 1] - [{', '.join(map(str, _LO))}][pos + 1])::DOUBLE, 9) AS value FROM g""")
def initial_population(spark, sf_dir):
    p = ga.initial(spark, _LO, _HI, seed=4, population=table(spark, sf_dir, "nation").count())
    return concatenated(p, "genes", ["idx"]).withColumn("value", F.round("value", 9))


@query("SELECT g::INT AS g, (2 + floor(3 * (g / 300.0)))::INT AS elite, greatest(2, trunc(10 - g / 30.0))::INT AS tournament, round(greatest(0.5, least(1.0, 1.0 - g / 300.0))::DOUBLE, 9) AS crossover, round(greatest(0.01, least(0.5, 0.5 - g / 300.0))::DOUBLE, 9) AS mutation FROM range(300) r(g)")
def search_schedule(spark, sf_dir):
    rows = [(g, ga.elite_size(g, _N), ga.tournament_size(g, _N), round(ga.rate(ga.CROSSOVER, g, _N), 9), round(ga.rate(ga.MUTATION, g, _N), 9)) for g in range(_N)]
    return spark.createDataFrame(rows, "g int, elite int, tournament int, crossover double, mutation double")


_K, _T, _S = ga.elite_size(_G, _N), ga.tournament_size(_G, _N, _POP), 3 * 1000003 + _G
_CHILD = f"'3:{_G}:' || idx || ':"


@query(f"""WITH s AS (SELECT n_nationkey::INT AS idx, [n_nationkey::DOUBLE, n_regionkey::DOUBLE, 0.5::DOUBLE] AS g, (n_regionkey + n_nationkey % 4)::DOUBLE AS f FROM nation),
d AS (SELECT t, idx, f, row_number() OVER (PARTITION BY t ORDER BY {_U.format(f"'{_S}:' || t || ':' || idx")}, idx) AS place FROM s, range({_POP - _K}) r(t)),
w AS (SELECT t AS place, idx FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY f DESC, place) AS rk FROM d WHERE place <= {_T}) WHERE rk = 1),
e AS (SELECT row_number() OVER (ORDER BY idx) - 1 + {_POP - _K} AS place, idx FROM s WHERE f >= (SELECT min(f) FROM (SELECT f FROM s ORDER BY f DESC LIMIT {_K}))),
p AS (SELECT place, g FROM (SELECT * FROM w UNION ALL SELECT * FROM e) JOIN s USING (idx) WHERE place < {_POP}),
c AS (SELECT i::INT AS idx, floor(({_U.format("'3:30:' || i || ':a'")})::DOUBLE * {_POP})::BIGINT AS a, floor(({_U.format("'3:30:' || i || ':b'")})::DOUBLE * {_POP})::BIGINT AS b,
  (floor(({_U.format("'3:30:' || i || ':cut'")})::DOUBLE * 2) + 1)::INT AS cut, ({_U.format("'3:30:' || i || ':cross'")})::DOUBLE < {ga.rate(ga.CROSSOVER, _G, _N)} AS crosses FROM range({_POP}) r(i)),
x AS (SELECT c.idx, pos, CASE WHEN crosses AND pos >= cut THEN q.g[pos + 1] ELSE p.g[pos + 1] END AS x FROM c JOIN p ON p.place = c.a JOIN p q ON q.place = c.b, range(3) r(pos))
SELECT idx, pos::INT AS pos, round(CASE WHEN ({_U.format(_CHILD + "' || pos || ':whether'")})::DOUBLE < {ga.rate(ga.MUTATION, _G, _N)}
  THEN greatest([{', '.join(map(str, _LO))}][pos + 1]::DOUBLE, least([{', '.join(map(str, _HI))}][pos + 1]::DOUBLE, x + (-0.1::DOUBLE + ({_U.format(_CHILD + "' || pos || ':move'")})::DOUBLE * 0.2::DOUBLE))) ELSE x END, 9) AS value FROM x""")
def next_generation(spark, sf_dir):
    """The children of a scored population: winners, elites with ties, crossover, mutation."""
    child = ga.next_generation(_individuals(spark, sf_dir), _LO, _HI, _G, _N, seed=3, population=_POP)
    return concatenated(child, "genes", ["idx"]).withColumn("value", F.round("value", 9))


def _search_sql(lo: list[float], hi: list[float], generations: int, population: int) -> str:
    """The whole search with seed 0, generation after generation, towards the middle of every range."""
    los, his = (f"[{', '.join(f'{x!r}::DOUBLE' for x in v)}]" for v in (lo, hi))
    u = lambda text: f"({_U.format(text)})::DOUBLE"
    each = f"range({len(lo)})"
    parts = [f"""p0 AS MATERIALIZED (SELECT i::INT AS idx, list_transform({each}, lambda j: {los}[j + 1] + {u("'0:start:' || i || ':' || j")} * ({his}[j + 1] - {los}[j + 1])) AS g FROM range({population}) r(i))"""]
    for n in range(generations):
        parts.append(f"""s{n} AS MATERIALIZED (SELECT idx, g, -list_sum(list_transform({each}, lambda j: abs((g[j + 1] - ({los}[j + 1] + {his}[j + 1]) / 2) / ({his}[j + 1] - {los}[j + 1])))) AS f FROM p{n})""")
        k, size = ga.elite_size(n, generations), ga.tournament_size(n, generations, population)
        moved = f"greatest({los}[j + 1], least({his}[j + 1], g[j + 1] + (-0.1::DOUBLE + {u(f"'0:{n}:' || idx || ':' || j || ':move'")} * 0.2::DOUBLE)))"
        parts.append(f"""d{n} AS (SELECT t, idx, f, row_number() OVER (PARTITION BY t ORDER BY {_U.format(f"'{n}:' || t || ':' || idx")}, idx) AS place FROM s{n}, range({population - k}) r(t)),
w{n} AS (SELECT t AS place, idx FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY f DESC, place) AS rk FROM d{n} WHERE place <= {size}) WHERE rk = 1),
e{n} AS (SELECT row_number() OVER (ORDER BY idx) - 1 + {population - k} AS place, idx FROM s{n} WHERE f >= (SELECT min(f) FROM (SELECT f FROM s{n} ORDER BY f DESC LIMIT {k}))),
q{n} AS MATERIALIZED (SELECT place, g FROM (SELECT * FROM w{n} UNION ALL SELECT * FROM e{n}) JOIN s{n} USING (idx) WHERE place < {population}),
c{n} AS (SELECT i::INT AS idx, floor({u(f"'0:{n}:' || i || ':a'")} * {population})::BIGINT AS a, floor({u(f"'0:{n}:' || i || ':b'")} * {population})::BIGINT AS b,
  (floor({u(f"'0:{n}:' || i || ':cut'")} * {len(lo) - 1}) + 1)::INT AS cut, {u(f"'0:{n}:' || i || ':cross'")} < {ga.rate(ga.CROSSOVER, n, generations)!r} AS crosses FROM range({population}) r(i)),
x{n} AS MATERIALIZED (SELECT c.idx, CASE WHEN crosses THEN list_concat(p.g[1:cut], q.g[cut + 1:{len(lo)}]) ELSE p.g END AS g FROM c{n} c JOIN q{n} p ON p.place = c.a JOIN q{n} q ON q.place = c.b),
p{n + 1} AS MATERIALIZED (SELECT idx, list_transform({each}, lambda j: CASE WHEN {u(f"'0:{n}:' || idx || ':' || j || ':whether'")} < {ga.rate(ga.MUTATION, n, generations)!r} THEN {moved} ELSE g[j + 1] END) AS g FROM x{n})""")
    return f"WITH {', '.join(parts)} SELECT idx, round(f, 9) AS fitness FROM s{generations - 1}"


ORACLE_SQL["genetic_search"] = _search_sql([g[2] for g in ga.GENES if g[1]], [g[3] for g in ga.GENES if g[1]], 3, ga.POPULATION)
