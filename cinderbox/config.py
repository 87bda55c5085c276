"""Run options: typed, checked, with overrides and fallbacks; process environment."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RunConfig:
    """Options of a training or search run. Empty text, False and None of optional paths all mean absent."""

    weights: str | None = None
    cfg: str | None = None
    data: str | None = None
    hyp: str | None = None
    epochs: int = 100
    batch_size: int = 16
    imgsz: int = 640
    rect: bool = False
    resume: bool = False
    nosave: bool = False
    noval: bool = False
    noautoanchor: bool = False
    noplots: bool = False
    evolve: int | None = None
    evolve_population: str | None = None
    resume_evolve: str | None = None
    bucket: str | None = None
    cache: str | None = None
    image_weights: bool = False
    device: str | None = None
    multi_scale: bool = False
    single_cls: bool = False
    optimizer: str = "SGD"
    sync_bn: bool = False
    workers: int = 8
    project: str = "runs/train"
    name: str = "exp"
    exist_ok: bool = False
    quad: bool = False
    cos_lr: bool = False
    label_smoothing: float = 0.0
    patience: int = 100
    freeze: tuple[int, ...] = (0,)
    save_period: int = -1
    seed: int = 0
    local_rank: int = -1
    entity: str | None = None
    upload_dataset: bool = False
    bbox_interval: int = -1
    artifact_alias: str = "latest"
    ndjson_console: bool = False
    ndjson_file: bool = False

    OPTIMIZERS = ("SGD", "Adam", "AdamW")

    def __post_init__(self):
        for f in ("weights", "cfg", "data", "hyp", "evolve_population", "resume_evolve", "bucket", "cache", "device", "entity"):
            object.__setattr__(self, f, getattr(self, f) or None)
        if self.optimizer not in self.OPTIMIZERS:
            raise ValueError(f"optimizer must be one of {', '.join(self.OPTIMIZERS)}")
        if self.batch_size == 0 or self.batch_size < -1:
            raise ValueError("batch_size must be positive, or -1 for automatic")
        if self.evolve and self.resume:
            object.__setattr__(self, "resume", False)

    def with_options(self, **options) -> RunConfig:
        """A copy with options replaced; unknown names raise."""
        unknown = set(options) - {f.name for f in fields(self)}
        if unknown:
            raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
        return replace(self, **options)

    def named(self) -> RunConfig:
        """Default project and name rewritten for a search, and the name after the model file where it is ``cfg``."""
        out = self
        if out.evolve and out.project == "runs/train":
            out = replace(out, project="runs/evolve", exist_ok=out.resume, resume=False)
        if out.name == "cfg" and out.cfg:
            out = replace(out, name=out.cfg.rsplit("/", 1)[-1].rsplit(".", 1)[0])
        return out

    def check(self, environment: Environment) -> RunConfig:
        """Raises where options exclude each other on several processes."""
        if not (self.cfg or self.weights):
            raise ValueError("either cfg or weights must be given")
        if environment.rank != -1:
            for bad, why in ((self.image_weights, "image_weights"), (self.evolve, "evolve"), (self.batch_size == -1, "automatic batch_size")):
                if bad:
                    raise ValueError(f"{why} is not possible on several processes")
            if self.batch_size % environment.world_size:
                raise ValueError("batch_size must be a multiple of the number of processes")
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row of all options as text, for lineage."""
        return spark.createDataFrame([{k: None if v is None else str(v) for k, v in asdict(self).items()}], ", ".join(f"`{f.name}` string" for f in fields(self)))


@dataclass(frozen=True)
class Environment:
    """Place of this process among several; outside of them rank is -1."""

    local_rank: int = field(default_factory=lambda: int(os.getenv("LOCAL_RANK", "-1")))
    rank: int = field(default_factory=lambda: int(os.getenv("RANK", "-1")))
    world_size: int = field(default_factory=lambda: int(os.getenv("WORLD_SIZE", "1")))

    @property
    def first(self) -> bool:
        return self.rank in (-1, 0)


def first_of(*options: dict | None) -> dict:
    """The first set of options that exists, as for a run's own file and else what its checkpoint holds."""
    for o in options:
        if o is not None:
            return o
    raise FileNotFoundError("no options found")
