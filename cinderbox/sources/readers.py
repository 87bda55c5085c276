"""Sources: frames, images, key-value files, populations, checkpoints. All paths go through Spark's file systems."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from cinderbox.operators.ranges import range_of, running_in_ranges

FRAME = "frame_id long, ts timestamp, height int, width int, n_channels int, data binary"


def images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a folder as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def batches(df: DataFrame, size: int, key: str) -> DataFrame:
    """Rows with the number of their batch by key order inside ranges of keys."""
    return df.withColumn("batch", F.floor(F.col(key) / size))


def stem(path: Column) -> Column:
    """A file's name without folders and suffix."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def labelled_images(spark: SparkSession, image_path: str, label_path: str, image_glob: str = "*", label_glob: str = "*.txt",
                    by_folder: bool = False) -> DataFrame:
    """Images with the boxes of the label file of the same stem: path, stem, length, content, boxes.

    A label file has a line ``class x y width height`` for each box, in shares
    of the image; ``boxes`` is an array of (cls, x, y, w, h) in line order, empty
    for images without a file. A line that has other than five numbers raises.
    ``by_folder``: files are told by their folders' names instead of their own.
    """
    name = (lambda p: F.element_at(F.split(p, "/"), -2)) if by_folder else stem
    files = spark.read.option("pathGlobFilter", label_glob).text(label_path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")

    def box(line: Column) -> Column:
        v = F.split(F.trim(line), r"\s+")
        fields = [F.get(v, 0).cast("int").alias("cls"), *[F.get(v, i).cast("double").alias(n) for i, n in enumerate("xywh", 1)]]
        return F.when(F.size(v) == 5, F.struct(*fields)).otherwise(F.raise_error(F.concat(F.lit("not a box: "), line)))

    boxes = files.select(name(F.input_file_name()).alias("__stem"), F.transform(lines, box).alias("boxes"))
    found = images(spark, image_path, image_glob).withColumn("stem", name(F.col("path")))
    found = found.join(boxes, F.col("stem") == F.col("__stem"), "left")
    none = F.array().cast("array<struct<cls:int,x:double,y:double,w:double,h:double>>")
    return found.select("path", "stem", "length", "content", F.coalesce("boxes", none).alias("boxes"))


def rectangles(df: DataFrame, height: str, width: str, size: int, batch: int, key: str, stride: int = 32) -> DataFrame:
    """Images dealt into batches of like shape: batch, and the batch's height and width, raised to whole strides.

    Rows are ordered by aspect ratio over ranges of it; the longer side of a batch is ``size``.
    """
    x = df.withColumn("__ratio", F.col(height) / F.col(width))
    x = running_in_ranges(x, [], range_of(x, "__ratio"), [F.col("__ratio").asc(), F.col(key).asc()], {"__n": F.lit(1).cast("long")})
    x = x.withColumn("batch", F.floor((F.col("__n") - 1) / batch))
    shape = x.groupBy(F.col("batch").alias("__batch")).agg(F.min("__ratio").alias("lo"), F.max("__ratio").alias("hi"))
    tall = F.when(F.col("hi") < 1, F.col("hi")).otherwise(F.lit(1.0))
    wide = F.when(F.col("lo") > 1, 1 / F.col("lo")).otherwise(F.lit(1.0))
    whole = lambda c: (F.ceil(c * size / stride) * stride).cast("long")
    shape = shape.select("__batch", whole(tall).alias("batch_height"), whole(wide).alias("batch_width"))
    return x.join(shape, F.col("batch") == F.col("__batch")).drop("__batch", "__block", "__ratio", "__n")


_LINE = re.compile(r"^(\s*)([^\s#:][^:]*):\s*(.*?)\s*(?:#.*)?$")


def parse_map(text: str) -> dict:
    """A file of ``key: value`` lines, with one level of nesting by indentation; numbers, true, false, null and text."""
    out: dict = {}
    inner = None
    for line in text.splitlines():
        m = _LINE.match(line)
        if not m or line.lstrip().startswith("#"):
            continue
        indent, key, value = m[1], m[2].strip().strip("'\""), m[3]
        target = inner if indent and inner is not None else out
        if value == "" and not indent:
            inner = out[key] = {}
            continue
        if not indent:
            inner = None
        target[int(key) if re.fullmatch(r"\d+", key) else key] = scalar(value)
    return out


def scalar(text: str):
    if text in ("", "~", "null", "None"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    return text.strip("'\"")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text; bytes that are no UTF-8 are left out."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return bytes(content).decode("utf-8", "ignore")


def hyperparameters(spark: SparkSession, given: str | dict) -> dict:
    """A mapping as it is, or read from a path."""
    return dict(given) if isinstance(given, dict) else parse_map(read_text(spark, given))


def dataset(spark: SparkSession, given: str | dict, single_class: bool = False) -> dict:
    """Descriptor of a dataset, checked: train, val, nc, names (number to name)."""
    d = hyperparameters(spark, given)
    for key in ("train", "val", "names"):
        if key not in d:
            raise ValueError(f"the dataset has no {key}")
    names = dict(enumerate(d["names"])) if isinstance(d["names"], list) else d["names"]
    d["nc"] = 1 if single_class else int(d.get("nc", len(names)))
    d["names"] = {0: "item"} if single_class and len(names) != 1 else names
    if len(d["names"]) != d["nc"]:
        raise ValueError("names and nc differ")
    return d


def class_table(spark: SparkSession, names: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(sorted(names.items()), "cls int, name string")


def map_files(spark: SparkSession, path: str, glob: str = "*.yaml") -> DataFrame:
    """One row for each file in path order: path, and its entries as a map of text. In bulk, so parsed on the executors."""
    entries = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^[^\s#:][^:]*:\s*\S"))
    split = F.transform(entries, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^:]*:\s*", ""), r"\s+#.*$", "")).alias("value")))
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.map_from_entries(split).alias("entries")).orderBy("path")


def population_seeds(spark: SparkSession, path: str, names: list[str], glob: str = "*.yaml", most: int = 1000) -> list[list[float]]:
    """Individuals from a file of nested maps, or from all files of a folder in name order, of which there may be ``most``."""
    if re.search(r"\.ya?ml$", path):
        found = list(parse_map(read_text(spark, path)).values())
    else:
        found = [r.entries for r in map_files(spark, path, glob).limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"more than {most} seed files")
    return [[float(individual[n]) for n in names] for individual in found]


def latest(spark: SparkSession, path: str, glob: str = "last*") -> str | None:
    """The newest file below a folder, recursively."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def unmatched_options(m: Column, known: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(known))


class FrameSource(DataSource):
    """Synthetic camera: a stream or table of frames of a given size; ends after ``frames``, an error is an error.

    Options: width, height, frames, per_batch, fail_at (raise when this frame is read).
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME

    def _int(self, key: str, default: int) -> int:
        return int(self.options.get(key, default))

    def reader(self, schema) -> DataSourceReader:
        return _FrameTable(self)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _FrameStream(self)

    def row(self, i: int) -> tuple:
        import datetime

        w, h = self._int("width", 640), self._int("height", 480)
        if i == self._int("fail_at", -1):
            raise RuntimeError(f"frame {i} cannot be read")
        pattern = bytes((i + k) % 256 for k in range(w * 3))
        return i, datetime.datetime(2000, 1, 1) + datetime.timedelta(milliseconds=40 * i), h, w, 3, pattern * h


class _FrameTable(DataSourceReader):
    def __init__(self, source: FrameSource):
        self.source = source

    def partitions(self):
        n = self.source._int("frames", 10)
        return [_Range(a, min(a + 100, n)) for a in range(0, n, 100)]

    def read(self, partition):
        for i in range(partition.start, partition.end):
            yield self.source.row(i)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _FrameStream(SimpleDataSourceStreamReader):
    def __init__(self, source: FrameSource):
        self.source = source

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def read(self, start: dict):
        end = min(start["frame"] + self.source._int("per_batch", 5), self.source._int("frames", 10))
        return iter([self.source.row(i) for i in range(start["frame"], end)]), {"frame": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([self.source.row(i) for i in range(start["frame"], end["frame"])])

    def commit(self, end: dict) -> None:
        pass
