"""Encoding frame by frame: parameters are set, frames are handed over one at a time, groups of coded units come out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import codec
from .params import Parameters, resolve
from .plans import pipeline


class Encoder:
    """A run: set() and initialise() once, then encode_frame() for each frame in order, flush() after the last, stop().

    Frames are DataFrames; nothing is computed before a group is complete, and a group's units are a DataFrame that reads its own frames only.
    What the encoder keeps of a group is freed when the next one is handed out, so take a group's rows before that.
    """

    def __init__(self, spark: SparkSession, coder: codec.MapCodec | None = None):
        self.spark, self.coder = spark, coder
        self.given: dict[str, str] = {}
        self.errors: list[str] = []
        self.parameters: Parameters | None = None
        self.held: list[DataFrame] = []
        self.next, self.tables, self.stopped = 0, None, False

    def set(self, name: str, value: str) -> None:
        """A parameter by its published name or its field; each once, and before initialise()."""
        if self.parameters is not None:
            raise RuntimeError("parameters can't be set after initialise()")
        if name in self.given:
            self.errors.append(f"{name} has already been set, to {self.given[name]}")
        self.given.setdefault(name, value)

    def initialise(self) -> Parameters:
        """Checks all that was set. Errors of set() are errors here, unless errorsAreFatal is false."""
        if "geoBitDepthInput" not in self.given and "input_depth" not in self.given:
            raise ValueError("geoBitDepthInput has to be set")
        if self.errors and self.given.get("errorsAreFatal", "true").lower() in ("true", "1"):
            raise ValueError("; ".join(self.errors))
        depth = int(self.given.get("geoBitDepthInput", self.given.get("input_depth", "10")))
        self.parameters = resolve(depth, overrides=",".join(f"{k}={v}" for k, v in self.given.items() if k not in ("geoBitDepthInput", "input_depth")))
        return self.parameters

    def encode_frame(self, points: DataFrame) -> DataFrame | None:
        """Takes the next frame, points(pt_idx, x, y, z, r, g, b); the units of a group if this completes one."""
        if self.parameters is None or self.stopped:
            raise RuntimeError("initialise() comes first, stop() last")
        self.held.append(points.drop("frame_id").withColumn("frame_id", F.lit(self.next).cast("int")))
        self.next += 1
        return self._group() if len(self.held) == self.parameters.gof_size else None

    def flush(self) -> DataFrame | None:
        """The units of the last group, if it is short."""
        return self._group() if self.held else None

    def stop(self) -> None:
        self._release()
        self.held, self.stopped = [], True

    def _group(self) -> DataFrame:
        self._release()
        points = reduce(DataFrame.unionByName, self.held)
        self.held = []
        self.tables = pipeline.encode(points, self.parameters)
        return pipeline.all_units(self.tables, self.parameters, self.coder)

    def _release(self) -> None:
        if self.tables is not None:
            pipeline.release(self.tables)
            self.tables = None
