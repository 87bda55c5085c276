"""The detection plan: predictions in, labelled detections in drawing order out."""

from __future__ import annotations

import colorsys
from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderbox.functions.expr import colour, label_text
from cinderbox.functions.image import to_tensor
from cinderbox.operators.boxes import above, rescale, suppress, with_names

def palette(size: int) -> list[str]:
    """Colours as hexadecimal red, green, blue: hues a golden section of the circle apart, full and half bright in turn (definition ours)."""
    out = []
    for i in range(size):
        rgb = colorsys.hsv_to_rgb(i * 0.618034 % 1, 0.75, 1.0 if i % 2 == 0 else 0.6)
        out.append("".join(f"{round(255 * x):02X}" for x in rgb))
    return out


PALETTE = palette(10)


def inferred(frames: DataFrame, make_predict: Callable, shape: tuple[int, int, int] = (3, 480, 640), batch_size: int = 1) -> DataFrame:
    """Raw predictions of a plug-in model, loaded once a worker: frame_id, pred_id, conf, cls, box.

    ``make_predict`` returns a function from a batch of float32 tensors
    (channels first, RGB, 0 to 1) to an array of n x 6 numbers a frame: x1, y1,
    x2, y2, conf, cls, flattened. Frames share one ``shape``.
    """
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[list(shape)])
    flat = predict(to_tensor("data", "height", "width", "n_channels"))
    each = F.transform(F.sequence(F.lit(0), F.floor(F.size("__p") / 6).cast("int") - 1), lambda i: F.slice("__p", i * 6 + 1, 6))
    x = frames.withColumn("__p", flat).where(F.size("__p") >= 6).select("frame_id", F.posexplode(each).alias("pred_id", "p"))
    names = ("x1", "y1", "x2", "y2", "conf", "cls")
    return x.select("frame_id", "pred_id", *[F.get("p", i).alias(n) for i, n in enumerate(names)]).withColumn("cls", F.col("cls").cast("int"))


def labelled(detections: DataFrame, classes: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Detections with name, label, colour and draw (1 is drawn first: the least confident)."""
    x = with_names(detections, classes)
    draw = F.row_number().over(Window.partitionBy(frame).orderBy(F.asc("conf"), F.desc("pred_id"))).cast("long")
    return x.withColumns({"label": label_text(F.col("name"), F.col("conf")), "colour": colour(F.col("cls"), PALETTE), "draw": draw})


def detect(raw: DataFrame, classes: DataFrame, conf: float = 0.5, iou: tuple[int, int] = (1, 2), tensor: tuple[int, int] = (480, 640),
           image: tuple[int, int] = (480, 640), across_classes: bool = False) -> DataFrame:
    """Threshold, suppression, rescaling and labels of raw predictions."""
    frame = ["frame_id"] if across_classes else ["frame_id", "cls"]
    kept = suppress(above(raw, "conf", conf), frame, "conf", "pred_id", iou)
    if across_classes:
        kept = kept.join(raw.select("frame_id", "pred_id", "cls"), ["frame_id", "pred_id"])
    return labelled(rescale(kept, tensor, image), classes)


def annotated(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """All frames, each with its labels in drawing order (none for frames without detections)."""
    per = detections.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "label"))), lambda x: x.label).alias("labels"))
    return frames.join(per, "frame_id", "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
