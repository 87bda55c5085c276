"""The engine's queries over the driver's tables, and their SQL.

The tables hold no images or boxes. Detections, labels, runs and genes are
derived from them by fixed arithmetic (see each query), as stand-ins that
exercise the operators.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderbox.functions import expr as E
from cinderbox.functions import image as I
from cinderbox.operators import boxes, labels, metrics, runs, sample, selection
from cinderbox.operators import evolve as ga
from cinderbox.plans import live
from cinderbox.streaming import detections as stream

QUERIES = {}
ORACLE_SQL = {}

CLASSES = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one that the session names; a local one only where Spark itself is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cinderbox-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i, c) for i, c in enumerate(CLASSES)], "event_type string, cls int, name string")


def events_as_boxes(spark: SparkSession, sf_dir: str, above: float = 50.0) -> DataFrame:
    """Events as detections: a user's events are a frame, values a confidence, ids give 40 x 40 boxes."""
    x = boxes.above(table(spark, sf_dir, "events"), "value", above)
    x = x.select(F.col("user_id").alias("frame_id"), F.col("event_type").alias("cls"), "event_id", F.col("value").alias("conf"),
                 ((F.col("event_id") * 37) % 60).alias("x1"), ((F.col("event_id") * 53) % 60).alias("y1"))
    return x.withColumns({"x2": F.col("x1") + 40, "y2": F.col("y1") + 40})


_BOXES = """b AS (SELECT user_id AS frame_id, event_type AS cls, event_id, value AS conf,
  (event_id * 37) % 60 AS x1, (event_id * 53) % 60 AS y1 FROM events WHERE value > 50)"""
_INTER = "greatest(0, 40 - abs(p.x1 - q.x1)) * greatest(0, 40 - abs(p.y1 - q.y1))"


# ---------------------------------------------------------------- detections

@query("SELECT event_id, user_id AS frame_id, event_type AS cls, value / 500 AS conf FROM events WHERE value > 250")
def det_threshold(spark, sf_dir):
    x = boxes.above(table(spark, sf_dir, "events"), "value", 250.0)
    return x.select("event_id", F.col("user_id").alias("frame_id"), F.col("event_type").alias("cls"), (F.col("value") / 500).alias("conf"))


@query("""WITH d AS (SELECT event_id, user_id AS frame_id, event_type AS name, value / 500 AS conf FROM events WHERE value > 250)
SELECT event_id, frame_id, name, concat(name, ' ', printf('%.2f', round_even(conf, 2))) AS label,
  row_number() OVER (PARTITION BY frame_id ORDER BY conf, event_id DESC) AS draw FROM d""")
def det_labels(spark, sf_dir):
    d = det_threshold(spark, sf_dir).withColumnRenamed("cls", "event_type").withColumnRenamed("event_id", "pred_id")
    d = d.join(class_table(spark).select("event_type", "cls"), "event_type", "left")
    out = live.labelled(d, class_table(spark).select("cls", "name"))
    return out.select(F.col("pred_id").alias("event_id"), "frame_id", "name", "label", "draw")


def _nms_sql(by: str, on: str) -> str:
    return f"""WITH RECURSIVE {_BOXES},
o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY conf DESC, event_id) AS rn FROM b),
r AS (SELECT frame_id, cls AS cls0, rn, [{{'id': event_id, 'x1': x1, 'y1': y1}}] AS kept FROM o WHERE rn = 1
  UNION ALL SELECT q.frame_id, q.cls, q.rn, CASE WHEN len(list_filter(r.kept, lambda p: 3 * {_INTER} > 3200)) > 0
    THEN r.kept ELSE list_append(r.kept, {{'id': q.event_id, 'x1': q.x1, 'y1': q.y1}}) END
  FROM r JOIN o AS q ON {on} AND q.rn = r.rn + 1),
k AS (SELECT unnest(arg_max(kept, rn)).id AS event_id FROM r GROUP BY {by.replace('cls', 'cls0')})
SELECT event_id, frame_id, cls, conf FROM k JOIN b USING (event_id)"""


@query(_nms_sql("frame_id, cls", "q.frame_id = r.frame_id AND q.cls = r.cls0"))
def det_nms(spark, sf_dir):
    return boxes.suppress(events_as_boxes(spark, sf_dir), ["frame_id", "cls"], "conf", "event_id").select("event_id", "frame_id", "cls", "conf")


@query(_nms_sql("frame_id", "q.frame_id = r.frame_id"))
def det_nms_across_classes(spark, sf_dir):
    x = events_as_boxes(spark, sf_dir)
    kept = boxes.suppress(x, ["frame_id"], "conf", "event_id")
    return kept.join(x.select("event_id", "cls"), "event_id").select("event_id", "frame_id", "cls", "conf")


@query(ORACLE_SQL["det_nms"])
def det_nms_grouped_pandas(spark, sf_dir):
    return boxes.suppress_pandas(events_as_boxes(spark, sf_dir), ["frame_id", "cls"], "conf", "event_id").select("event_id", "frame_id", "cls", "conf")


@query(f"""WITH {_BOXES} SELECT frame_id, cls, p.event_id AS id_a, q.event_id AS id_b,
  ({_INTER})::DOUBLE / (3200 - {_INTER}) AS iou FROM b p JOIN b q USING (frame_id, cls) WHERE p.event_id < q.event_id AND {_INTER} > 0""")
def iou_pairs(spark, sf_dir):
    return boxes.overlap_pairs(events_as_boxes(spark, sf_dir), ["frame_id", "cls"], "event_id")


@query(ORACLE_SQL["iou_pairs"])
def iou_pairs_by_cells(spark, sf_dir):
    return boxes.overlap_pairs(events_as_boxes(spark, sf_dir), ["frame_id", "cls"], "event_id", cell=50)


@query(f"""WITH {_BOXES} SELECT event_id, round_even(greatest(0, least(640, (x1 * 8) / 0.65)), 0)::BIGINT AS x1,
  round_even(greatest(0, least(640, ((x1 + 40) * 8) / 0.65)), 0)::BIGINT AS x2,
  round_even(greatest(0, least(480, (y1 * 8 - 52) / 0.65)), 0)::BIGINT AS y1,
  round_even(greatest(0, least(480, ((y1 + 40) * 8 - 52) / 0.65)), 0)::BIGINT AS y2 FROM b""")
def det_rescale(spark, sf_dir):
    x = events_as_boxes(spark, sf_dir)
    x = x.withColumns({c: F.col(c) * 8 for c in boxes.BOX})
    return boxes.rescale(x, (416, 416), (480, 640)).select("event_id", *boxes.BOX)


@query(f"""WITH {_BOXES}, t AS (SELECT event_id AS truth_id, frame_id, cls, (event_id * 41) % 60 AS x1, (event_id * 43) % 60 AS y1 FROM b),
m AS (SELECT frame_id, cls, p.event_id AS pred_id, truth_id, ({_INTER})::DOUBLE / (3200 - {_INTER}) AS iou FROM b p JOIN t q USING (frame_id, cls)),
f AS (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY iou DESC, truth_id) AS n FROM m WHERE iou >= 0.5),
g AS (SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY iou DESC, pred_id) AS n2 FROM f WHERE n = 1)
SELECT event_id AS pred_id, g.truth_id, g.iou FROM b LEFT JOIN (SELECT * FROM g WHERE n2 = 1) g ON g.pred_id = b.event_id""")
def det_match(spark, sf_dir):
    x = events_as_boxes(spark, sf_dir)
    t = x.select("frame_id", "cls", F.col("event_id").alias("truth_id"), ((F.col("event_id") * 41) % 60).alias("x1"), ((F.col("event_id") * 43) % 60).alias("y1"))
    t = t.withColumns({"x2": F.col("x1") + 40, "y2": F.col("y1") + 40})
    return boxes.match(x.withColumnRenamed("event_id", "pred_id"), t, ["frame_id", "cls"]).select("pred_id", "truth_id", "iou")


@query("""WITH d AS (SELECT user_id AS frame_id, event_id, value / 500 AS conf, event_type AS name FROM events WHERE value > 250),
l AS (SELECT frame_id, string_agg(concat(name, ' ', printf('%.2f', round_even(conf, 2))), '; ' ORDER BY conf, event_id DESC) AS labels FROM d GROUP BY frame_id)
SELECT c.c_custkey AS frame_id, coalesce(l.labels, '') AS labels FROM customer c LEFT JOIN l ON l.frame_id = c.c_custkey""")
def det_annotated_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("frame_id"))
    out = live.annotated(frames, det_labels(spark, sf_dir))
    return out.select("frame_id", F.array_join("labels", "; ").alias("labels"))


@query(f"SELECT event_id, ({live.PALETTE!r})[event_id % 10 + 1] AS colour FROM events")
def class_colour(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", E.colour(F.col("event_id"), live.PALETTE).alias("colour"))


# ---------------------------------------------------------------- runs

def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")


_SEQ = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"


@query("""SELECT event_id, sum(value::DECIMAL(28,6)) OVER w::DOUBLE / count(value) OVER w AS mean FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_loss(spark, sf_dir):
    return runs.running_mean(_runs(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value").select("event_id", "mean")


@query("""SELECT event_id, greatest(max(value) OVER w, 0.0) AS best,
  value > greatest(coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS improved
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def best_so_far(spark, sf_dir):
    return runs.best_so_far(_runs(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value").select("event_id", "best", "improved")


@query("""SELECT user_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def best_checkpoint(spark, sf_dir):
    return runs.best_row(_runs(spark, sf_dir), ["user_id"], "value", "ts", ["event_id"]).select("user_id", "value", "event_id")


@query(f"""WITH e AS (SELECT user_id, value, {_SEQ} AS epoch FROM events),
b AS (SELECT *, greatest(max(value) OVER w, 0.0) AS best FROM e WINDOW w AS (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, coalesce(max(CASE WHEN value >= best THEN epoch END) OVER w, 0) AS last_best FROM b WINDOW w AS (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING)),
s AS (SELECT user_id, min(epoch) AS stop, arg_min(last_best, epoch) AS last_best FROM l WHERE epoch - last_best >= 20 GROUP BY user_id)
SELECT user_id, epochs, stop, last_best FROM (SELECT user_id, count(*) AS epochs FROM events GROUP BY user_id) LEFT JOIN s USING (user_id)""")
def early_stop(spark, sf_dir):
    return runs.early_stop(_runs(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 20)


_ACC = "CASE WHEN {n} <= 30 THEN greatest(1, round_even(1 + least(greatest({n} / 30.0, 0), 1) * 3, 0)) ELSE 4 END"


@query(f"""WITH RECURSIVE c AS (SELECT user_id, count(*) AS steps FROM events GROUP BY user_id),
r AS (SELECT user_id, steps, 0::BIGINT AS ni, -1::BIGINT AS last, 0::BIGINT AS fires FROM c
  UNION ALL SELECT user_id, steps, ni + 1, CASE WHEN ni - last >= {_ACC.format(n='ni')} THEN ni ELSE last END,
    fires + CASE WHEN ni - last >= {_ACC.format(n='ni')} THEN 1 ELSE 0 END FROM r WHERE ni < steps)
SELECT user_id, steps, fires, last AS last_fire FROM r WHERE ni = steps""")
def step_trigger(spark, sf_dir):
    counts = _runs(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"))
    return runs.step_trigger(counts, ["user_id"], "steps", 30, 16)


@query("SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) + 1000 * (user_id % 7) AS ni FROM events")
def global_ordinal(spark, sf_dir):
    x = runs.ordinal_in_ranges(_runs(spark, sf_dir), ["event_type"], "ts", ["event_id"], "batch")
    return x.select("event_id", runs.global_step(F.col("batch"), F.col("user_id") % 7, 1000).alias("ni"))


@query("""WITH p AS (SELECT event_id, lag(value / 500, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS map FROM events)
SELECT event_id, map, 2.0::DOUBLE * (1 - map) * (1 - map) / 5 AS weight FROM p""")
def lag_feedback(spark, sf_dir):
    x = _runs(spark, sf_dir).withColumn("m", F.col("value") / 500)
    x = runs.previous(x, ["user_id"], ["ts", "event_id"], "m", "map")
    return x.select("event_id", "map", E.error_weight(F.lit(2.0), F.col("map"), 5).alias("weight"))


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch FROM events),
b AS (SELECT *, greatest(max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0.0) AS best FROM w)
SELECT event_id, true AS save_last, value = best AS save_best, epoch % 10 = 0 AS save_periodic FROM b""")
def checkpoint_roles(spark, sf_dir):
    x = runs.ordinal(_runs(spark, sf_dir), ["user_id"], ["ts", "event_id"], "epoch")
    return runs.checkpoints(x, ["user_id"], "epoch", "value", period=10).select("event_id", "save_last", "save_best", "save_periodic")


@query("""SELECT event_id, (NOT (event_id % 2 = 0)) OR (event_id % 3 = 0 AND NOT event_id % 5 = 0) AS save, (NOT (event_id % 2 = 0)) OR event_id % 3 = 0 AS validate FROM events""")
def save_and_validate_gates(spark, sf_dir):
    by = lambda n: F.col("event_id") % n == 0
    return _runs(spark, sf_dir).select("event_id", runs.save_gate(by(2), by(3), by(5)).alias("save"), runs.validate_gate(by(2), by(3)).alias("validate"))


@query("SELECT user_id, sqrt(sum((event_id % 13) * (event_id % 13))::DOUBLE) AS norm, least(1.0, 10 / sqrt(sum((event_id % 13) * (event_id % 13))::DOUBLE)) AS scale FROM events GROUP BY user_id HAVING sum(event_id % 13) > 0")
def gradient_clip(spark, sf_dir):
    x = _runs(spark, sf_dir).withColumn("g", (F.col("event_id") % 13).cast("double"))
    return runs.gradient_norm(x, ["user_id"], "g").where("norm > 0")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id % 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT user_id, 0::BIGINT AS k, 0.0::DOUBLE AS e FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT o.user_id, o.k, 0.75 * r.e + 0.25 * o.v FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, round(arg_max(e, k), 6) AS ema FROM r GROUP BY user_id""")
def ema_fold(spark, sf_dir):
    x = _runs(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 100).cast("double").alias("v")))).alias("s"))
    # a ramp this short has passed at the first update
    return x.select("user_id", F.round(E.moving_average(F.transform("s", lambda s: s.v), 0.75, 1e-3), 6).alias("ema"))


@query("""SELECT event_id, format('{:>11}', concat(user_id % 100, '/99')) || format('{:>11}', event_id % 1000) || format('{:>11}', 640) AS line FROM events""")
def progress_lines(spark, sf_dir):
    x = _runs(spark, sf_dir)
    return x.select("event_id", runs.progress_line(F.concat((F.col("user_id") % 100).cast("string"), F.lit("/99")), [], F.col("event_id") % 1000, F.lit(640).cast("long")).alias("line"))


# ---------------------------------------------------------------- schedules and scalars

@query("SELECT o_orderkey, (1 - (o_orderkey % 100)::DOUBLE / 100) * 0.99 + 0.01 AS rate FROM orders")
def lr_linear(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", E.linear_rate((F.col("o_orderkey") % 100).cast("double"), 100, 0.01).alias("rate"))


@query("SELECT o_orderkey, round(((1 - cos((o_orderkey % 100) * pi() / 100)) / 2) * (0.01 - 1) + 1, 9) AS rate FROM orders")
def lr_cosine(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(E.cosine_rate((F.col("o_orderkey") % 100).cast("double"), 100, 0.01), 9).alias("rate"))


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 300 AS ni, o_orderkey % 3 AS g FROM orders),
t AS (SELECT *, least(greatest((ni)::DOUBLE / 200, 0.0), 1.0) AS t FROM s)
SELECT o_orderkey, round(CASE WHEN ni <= 200 THEN (CASE WHEN g = 0 THEN 0.1 ELSE 0.0 END) + t * (0.008 - (CASE WHEN g = 0 THEN 0.1 ELSE 0.0 END)) ELSE 0.008 END, 9) AS rate,
  round(CASE WHEN ni <= 200 THEN 0.8 + t * (0.937 - 0.8) ELSE 0.937 END, 9) AS momentum,
  (CASE WHEN ni <= 200 THEN greatest(1, round_even(1 + t * 3, 0)) ELSE 4 END)::BIGINT AS accumulate FROM t""")
def warmup(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 300).alias("ni"), (F.col("o_orderkey") % 3).alias("g"))
    return x.select("o_orderkey", F.round(E.warmup_rate(F.col("ni"), F.col("g"), 200, 0.1, 0.01, F.lit(0.8)), 9).alias("rate"),
                    F.round(E.warmup_momentum(F.col("ni"), 200, 0.8, 0.937), 9).alias("momentum"), E.warmup_accumulate(F.col("ni"), 200, 16).alias("accumulate"))


@query("SELECT p_partkey, ((p_size // 32) * 32)::BIGINT AS lower, ceil(p_size / 32)::BIGINT * 32 AS upper, greatest(ceil(p_size / 32)::BIGINT * 32, 64) AS checked FROM part")
def stride_round(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", E.floor_to(s, 32).alias("lower"), E.ceil_to(s, 32).alias("upper"), E.image_size(s, 32).alias("checked"))


@query("SELECT p_partkey, greatest(10, least(30, p_size)) AS held, 0.5::DOUBLE + least(greatest(p_size / 50.0, 0), 1) * 2 AS between_, greatest(round_even(64.0 / p_size, 0), 1)::BIGINT AS accumulate, greatest(round_even(3.0 * p_size, 0), 100)::BIGINT AS steps FROM part")
def clamp_interp(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", E.clamp(s, 10, 30).alias("held"), E.interpolate(s.cast("double"), 0, 50, 0.5, 2.5).alias("between_"),
        E.accumulate_steps(s).alias("accumulate"), E.warmup_steps(3.0, s).alias("steps"))


@query("SELECT p_partkey, concat('weight_decay=', (p_size * 0.5)::DOUBLE::VARCHAR, ', box=', (p_size / 4.0)::DOUBLE::VARCHAR) AS text FROM part")
def hyp_text(spark, sf_dir):
    x = table(spark, sf_dir, "part")
    m = F.create_map(F.lit("weight_decay"), F.col("p_size").cast("double"), F.lit("box"), F.col("p_size").cast("double"), F.lit("anchors"), F.lit(3.0))
    return x.select("p_partkey", E.map_text(E.map_without(E.scaled_map(m, {"weight_decay": F.lit(0.5), "box": F.lit(0.25)}), ["anchors"])).alias("text"))


@query("SELECT p_partkey, p_size::DOUBLE AS lr0, 7.0::DOUBLE AS lrf, 2.0::DOUBLE AS momentum, 3.0::DOUBLE AS fallback FROM part")
def hyp_update(spark, sf_dir):
    left = F.create_map(F.lit("lr0"), F.lit(1.0), F.lit("momentum"), F.lit(2.0))
    right = F.create_map(F.lit("lr0"), F.col("p_size").cast("double"), F.lit("lrf"), F.lit(7.0))
    x = table(spark, sf_dir, "part").withColumn("m", E.map_update(left, right)).withColumn("v", E.map_vector(F.col("m"), ["lr0", "lrf", "momentum"]))
    back = E.vector_map(F.col("v"), ["lr0", "lrf", "momentum"])
    return x.select("p_partkey", back["lr0"].alias("lr0"), back["lrf"].alias("lrf"), back["momentum"].alias("momentum"), E.map_get(F.col("m"), "anchors", 3.0).alias("fallback"))


@query("""SELECT page_id, contains(url, 'blog') OR contains(url, 'm.') AS frozen, ends_with(url, '/') OR ends_with(url, '#top') AS tail,
  regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent FROM pages""")
def path_text(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", E.contains_any(u, ["blog", "m."]).alias("frozen"), E.suffixed(u, "/", "#top").alias("tail"), E.stem(u).alias("stem"), E.parent(u).alias("parent"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, round_even((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9, 3) AS hours FROM events""")
def times(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", E.iso_text(F.col("ts")).alias("iso"), E.elapsed_hours(F.lit("2024-01-01").cast("timestamp"), ts).alias("hours"))


# ---------------------------------------------------------------- labels

@query("""WITH r AS (SELECT i AS cls FROM range((SELECT max(label) + 2 FROM embeddings)) t(i)), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
x AS (SELECT cls, coalesce(n, 0) AS count, (1.0::DOUBLE / greatest(coalesce(n, 0), 1))::DECIMAL(30,18) AS inv FROM r LEFT JOIN c ON label = cls)
SELECT cls::INT AS cls, count, round(inv::DOUBLE / (sum(inv) OVER ())::DOUBLE, 12) AS weight FROM x""")
def class_weights(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    classes = e.agg(F.max("label")).first()[0] + 2  # one class without labels
    return labels.class_weights(e, classes, "label").withColumn("weight", F.round("weight", 12))


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), t AS (SELECT sum((1.0::DOUBLE / n)::DECIMAL(30,18)) AS t FROM c),
w AS (SELECT event_type, ((1.0::DOUBLE / n)::DECIMAL(30,18)::DOUBLE / t::DOUBLE)::DECIMAL(28,15) AS w FROM c, t)
SELECT user_id, round(sum(w)::DOUBLE, 9) AS weight, count(*) AS labels FROM events JOIN w USING (event_type) GROUP BY user_id""")
def image_weights(spark, sf_dir):
    x = table(spark, sf_dir, "events").join(class_table(spark).select("event_type", "cls"), "event_type")
    w = labels.class_weights(x, len(CLASSES))
    return labels.image_weights(x, w, "user_id", "cls").select("user_id", F.round("weight", 9).alias("weight"), "labels")


@query("SELECT max(label)::BIGINT AS largest, count(*) AS labels, max(label) < 10 AS ok FROM embeddings")
def label_range_check(spark, sf_dir):
    return labels.label_range(table(spark, sf_dir, "embeddings"), 10, "label")


@query("SELECT vec_id, (unnest(range(len(embedding))))::INT AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings")
def label_concat(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return labels.concatenated(e, "embedding", ["vec_id"]).select("vec_id", "pos", F.col("value").cast("double").alias("value"))


@query("SELECT count(*) AS images, count(DISTINCT user_id) AS users, sum(value > 250)::BIGINT AS instances, max(event_id) AS largest FROM events")
def counts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("images"), F.countDistinct("user_id").alias("users"), F.sum((F.col("value") > 250).cast("long")).alias("instances"), F.max("event_id").alias("largest"))


# ---------------------------------------------------------------- sampling

_U = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0"


@query(f"""WITH w AS (SELECT doc_id, quality * 2 + 1 AS w FROM labels), c AS (SELECT doc_id, w, sum(w) OVER (ORDER BY doc_id) AS hi FROM w),
t AS (SELECT sum(w) AS t, count(*) AS n FROM w), d AS (SELECT i AS draw, floor(({_U.format("'0:' || i")})::DOUBLE * t)::BIGINT AS spot FROM t, range(t.n) r(i))
SELECT draw, doc_id FROM d JOIN c ON spot < hi AND spot >= hi - w""")
def weighted_sample(spark, sf_dir):
    x = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + 1).cast("long").alias("w"))
    return sample.weighted_sample(x, "doc_id", "w", x.count())


@query(f"SELECT s_suppkey FROM supplier ORDER BY {_U.format("'5:' || s_suppkey")}, s_suppkey LIMIT 7")
def uniform_sample(spark, sf_dir):
    return sample.uniform_sample(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 7, seed=5)


@query(f"SELECT o_orderkey, ({_U.format("'3:' || o_orderkey")})::DOUBLE AS place FROM orders")
def epoch_shuffle(spark, sf_dir):
    return sample.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3)


@query(f"SELECT o_orderkey, (floor((floor(({_U.format("'0:' || o_orderkey")})::DOUBLE * 672) + 320) / 32) * 32)::BIGINT AS size FROM orders")
def multi_scale(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sample.random_sizes(F.col("o_orderkey"), 640, 32).alias("size"))


# ---------------------------------------------------------------- selection and search

@query("SELECT p_partkey, p_size FROM part WHERE p_size >= (SELECT min(p_size) FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 5))")
def elite_with_ties(spark, sf_dir):
    return selection.elite(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 5)


@query(f"""WITH d AS (SELECT t, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY t ORDER BY {_U.format("'0:' || t || ':' || s_suppkey")}, s_suppkey) AS place
  FROM supplier, range(5) r(t)), w AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY s_acctbal DESC, place) AS rk FROM d WHERE place <= 4)
SELECT t::INT AS t, s_suppkey, s_acctbal FROM w WHERE rk = 1""")
def tournament_select(spark, sf_dir):
    return selection.tournaments(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", 5, 4)


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 1")
def first_best(spark, sf_dir):
    return selection.first_best(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "p_partkey")


@query("SELECT s_nationkey AS n, s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AND NOT contains(s_nationkey::VARCHAR, '1')")
def key_intersect(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey")
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n"))
    return selection.shared_keys(s, c, "n", ["1"])


@query("SELECT n_nationkey AS n, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def key_except(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), "n_name")
    return selection.other_keys(n, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n")), "n")


@query("SELECT n_nationkey AS k, 0 AS part, -n_nationkey AS place FROM nation UNION ALL SELECT s_nationkey, 1, s_nationkey FROM supplier")
def bag_union(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return selection.ordered_union([(n, True), (s, False)], "k")


def _genes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("genes"))


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS g, len(embedding) AS n FROM embeddings),
c AS (SELECT a.vec_id, CASE WHEN ({_U.format("'1:30:' || a.vec_id || ':cross'")})::DOUBLE < 0.9
  THEN list_concat(a.g[1:k], b.g[k + 1:a.n]) ELSE a.g END AS g FROM
  (SELECT *, (floor(({_U.format("'1:30:' || vec_id || ':cut'")})::DOUBLE * 63) + 1)::INT AS k FROM e) a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, (unnest(range(len(g))))::INT AS pos, unnest(g) AS value FROM c""")
def crossover(spark, sf_dir):
    g = _genes(spark, sf_dir)
    pairs = g.join(g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("genes").alias("other")), "vec_id")
    child = pairs.select("vec_id", ga.crossed(F.col("genes"), F.col("other"), 30, 300, F.col("vec_id"), 1, 64).alias("genes"))
    return labels.concatenated(child, "genes", ["vec_id"])


@query(f"""WITH e AS (SELECT vec_id, (unnest(range(len(embedding))))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, pos, CASE WHEN ({_U.format("'1:30:' || vec_id || ':' || pos || ':whether'")})::DOUBLE < 0.4
  THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x + (-0.1::DOUBLE + ({_U.format("'1:30:' || vec_id || ':' || pos || ':move'")})::DOUBLE * (0.1::DOUBLE - -0.1::DOUBLE)))) ELSE x END AS value FROM e""")
def mutate(spark, sf_dir):
    out = _genes(spark, sf_dir).select("vec_id", ga.mutated(F.col("genes"), [-1.0] * 64, [1.0] * 64, 0.4, F.col("vec_id"), 30, 1).alias("genes"))
    return labels.concatenated(out, "genes", ["vec_id"])


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::INT, '{n}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (n, on, lo, hi) in enumerate(ga.GENES) if on) + ") t(pos, name, lo, hi)")
def gene_bounds(spark, sf_dir):
    return ga.gene_table(spark).where("evolve").select("pos", "name", "lo", "hi")


@query(None)
def genetic_search(spark, sf_dir):
    """Three generations towards the middle of every range; the fitness stands in for a training run."""
    mid = [(lo + hi) / 2 for _, on, lo, hi in ga.GENES if on]
    span = [hi - lo for _, on, lo, hi in ga.GENES if on]
    score = lambda g: F.aggregate(F.zip_with(F.zip_with(g, F.array(*map(F.lit, mid)), lambda a, b: a - b), F.array(*map(F.lit, span)), lambda d, s: F.abs(d / s)), F.lit(0.0), lambda a, x: a - x)
    scored, _ = ga.search(spark, lambda p: p.withColumn("fitness", score(F.col("genes"))), 3)
    return scored.select("idx", F.round("fitness", 9).alias("fitness"))


# ---------------------------------------------------------------- scores

@query("""WITH p AS (SELECT source, quality = 1 AS t, ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.7 AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, sum((p AND t)::INT)::BIGINT AS tp, sum((p AND NOT t)::INT)::BIGINT AS fp, sum((NOT p AND t)::INT)::BIGINT AS fn FROM p GROUP BY source)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c""")
def precision_recall(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.precision_recall(x, ["source"], E.hash_uniform(F.lit(0), F.col("doc_id")) < 0.7, F.col("quality") == 1)


@query("""WITH p AS (SELECT source, quality = 1 AS t, ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.7 AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, sum((p AND t)::INT) AS tp, sum((p AND NOT t)::INT) AS fp, sum((NOT p AND t)::INT) AS fn FROM p GROUP BY source),
r AS (SELECT source, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM c)
SELECT source, round(0.1 * pr + 0.9 * re, 9) AS fitness FROM r""")
def fitness_dot(spark, sf_dir):
    x = precision_recall(spark, sf_dir)
    return x.select("source", F.round(metrics.fitness(F.lit(0.0), F.lit(0.0), F.col("precision"), F.col("recall")), 9).alias("fitness"))


@query("""WITH p AS (SELECT event_type AS cls, event_id, value, ('0x' || substr(md5('0:' || event_id), 1, 8))::BIGINT / 4294967296.0 < 0.6 AS hit FROM events),
r AS (SELECT *, sum(hit::INT) OVER w AS tp, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY cls ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, max(tp / n) OVER (PARTITION BY cls ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS e FROM r), t AS (SELECT cls, count(*) AS truths FROM p GROUP BY cls)
SELECT cls, count(*) AS predictions, any_value(truths) AS truths, round(sum(CASE WHEN hit THEN e::DECIMAL(28,18) ELSE 0 END)::DOUBLE / any_value(truths), 9) AS ap FROM e JOIN t USING (cls) GROUP BY cls""")
def det_average_precision(spark, sf_dir):
    x = table(spark, sf_dir, "events").select(F.col("event_type").alias("cls"), "event_id", "value", (E.hash_uniform(F.lit(0), F.col("event_id")) < 0.6).alias("hit"))
    truths = x.groupBy("cls").agg(F.count(F.lit(1)).alias("truths"))
    return metrics.average_precision(x, ["cls"], "value", "event_id", "hit", truths)


# ---------------------------------------------------------------- images

@query("SELECT vec_id, (unnest(range(len(embedding))))::INT AS pos, floor(abs(unnest(embedding)::DOUBLE) * 100) / 255 AS value FROM embeddings")
def normalise_pixels(spark, sf_dir):
    px = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100))
    return labels.concatenated(table(spark, sf_dir, "embeddings").select("vec_id", I.unit_scaled(px).alias("p")), "p", ["vec_id"])


@query("SELECT vec_id, (i % 8 * 8 + i // 8)::INT AS pos, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(64) r(i)")
def permute(spark, sf_dir):
    t = I.transposed(F.col("embedding"), 8, 8)
    return labels.concatenated(table(spark, sf_dir, "embeddings").select("vec_id", t.alias("t")), "t", ["vec_id"]).withColumn("value", F.col("value").cast("double"))


@query("SELECT vec_id, embedding[3]::DOUBLE AS r, embedding[2]::DOUBLE AS g, embedding[1]::DOUBLE AS b FROM embeddings")
def bgr_to_rgb(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", I.reversed_channels(F.slice("embedding", 1, 3)).alias("p"))
    return x.select("vec_id", *[F.get("p", i).cast("double").alias(n) for i, n in enumerate("rgb")])


@query("""WITH g AS (SELECT vec_id, embedding AS e, i, j, greatest((i + 0.5) * 2 - 0.5, 0) AS r, greatest((j + 0.5) * 2 - 0.5, 0) AS c FROM embeddings, range(4) a(i), range(4) b(j))
SELECT vec_id, (i * 4 + j)::INT AS pos, round((e[(2*i)*8 + 2*j + 1]::DOUBLE + e[(2*i)*8 + 2*j + 2]::DOUBLE + e[(2*i + 1)*8 + 2*j + 1]::DOUBLE + e[(2*i + 1)*8 + 2*j + 2]::DOUBLE) / 4, 6) AS value FROM g""")
def bilinear_half(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", I.resized(F.col("embedding").cast("array<double>"), F.lit(8), F.lit(8), F.lit(4), F.lit(4)).alias("p"))
    return labels.concatenated(x, "p", ["vec_id"]).withColumn("value", F.round("value", 6))


# ---------------------------------------------------------------- stream

@query(ORACLE_SQL["det_threshold"])
def stream_events(spark, sf_dir):
    """The threshold plan over events read as a stream until the source is used up."""
    events = stream.table_stream(spark, sf_dir, "events")
    plan = lambda b: boxes.above(b, "value", 250.0).select("event_id", F.col("user_id").alias("frame_id"), F.col("event_type").alias("cls"), (F.col("value") / 500).alias("conf"))
    return stream.run_batches(events, plan, work_folder(spark, "stream"))
