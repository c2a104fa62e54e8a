"""A table of coded groups that takes every group once, however often its batch comes.

Layout: units/sequence=S/gof_id=G holds a group's rows, groups/sequence=S/gof_id=G/batch_id=N is its commit, a small file that appears in one
step after the rows. A batch that is replayed finds its own commits and does nothing for these groups; where it was lost before
a commit, its rows replace what it left. A group that another batch has committed is closed: what comes later of it goes to late/.
Readers see committed groups only. Looking up a commit is one look-up a group, so a batch costs the same after a million others.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch


def key(sequence: str) -> str:
    """A sequence's name as part of a path: no two names share one."""
    return "s-" + re.sub(r"[^A-Za-z0-9.-]", lambda m: f"_{ord(m[0]):x}_", sequence)


@dataclass
class GroupTable:
    spark: SparkSession
    out: str

    def folder(self, kind: str, sequence: str, gof: int) -> str:
        return f"{self.out}/{kind}/sequence={key(sequence)}/gof_id={gof}"

    def state(self, sequence: str, gof: int, batch: int) -> str:
        """new, done (by this batch) or closed (by another one)."""
        own = self.folder("groups", sequence, gof)
        if not scratch.exists(self.spark, own):
            return "new"
        return "done" if scratch.exists(self.spark, f"{own}/batch_id={batch}") else "closed"

    def add(self, groups: list[Row], batch: int, encode: Callable[[str, list[Row], Callable[[DataFrame], None]], None], in_flight: int) -> None:
        """Takes groups(sequence, gof_id, frames, ..) of a batch; encode(sequence, groups, take) hands their units to take, of at most in_flight frames (or one group) at once."""
        late, fresh = [], {}
        for g in sorted(groups, key=lambda g: (g["sequence"], g["gof_id"])):
            state = self.state(g["sequence"], g["gof_id"], batch)
            if state == "closed":
                late.append(g)
            elif state == "new":
                fresh.setdefault(g["sequence"], []).append(g)
        if late:
            rows = [(g["sequence"], g["gof_id"], list(g["frames"])) for g in late]
            self.spark.createDataFrame(rows, "sequence string, gof_id long, frames array<long>").coalesce(1).write.mode("overwrite").parquet(f"{self.out}/late/batch_id={batch}")
        for sequence, own in fresh.items():
            while own:
                n = 1
                while n < len(own) and sum(len(g["frames"]) for g in own[: n + 1]) <= in_flight:
                    n += 1
                now, own = own[:n], own[n:]
                encode(sequence, now, lambda units, s=sequence: self.write(s, units))
                for g in now:
                    scratch.mark(self.spark, f"{self.folder('groups', sequence, g['gof_id'])}/batch_id={batch}", f'{{"frames": {len(g["frames"])}}}')

    def write(self, sequence: str, units: DataFrame) -> None:
        """Rows of groups in the place of what an attempt without a commit has left of them."""
        rows = units.withColumn("sequence", F.lit(key(sequence))).repartition("gof_id")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sequence", "gof_id").parquet(f"{self.out}/units")

    def committed(self) -> DataFrame:
        """(sequence, gof_id, batch, frames) of every group; sequence as key() writes it."""
        if not scratch.exists(self.spark, f"{self.out}/groups"):
            return self.spark.createDataFrame([], "sequence string, gof_id long, batch long, frames int")
        rows = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "batch_id=*").text(f"{self.out}/groups").select("value", F.col("_metadata.file_path").alias("path"))
        rows = rows.filter(~F.col("path").endswith(".tmp"))
        part = lambda name, kind: F.regexp_extract("path", f"{name}=([^/]+)", 1).cast(kind).alias(name)
        return rows.select(F.regexp_extract("path", "sequence=([^/]+)", 1).alias("sequence"), part("gof_id", "long"), part("batch_id", "long").alias("batch"), F.get_json_object("value", "$.frames").cast("int").alias("frames"))

    def units(self) -> DataFrame:
        """(sequence, gof_id, unit_seq, unit_type, payload) of committed groups."""
        done = self.committed().select("sequence", "gof_id").distinct()
        rows = self.spark.read.schema("unit_seq int, unit_type string, payload binary, sequence string, gof_id long").parquet(f"{self.out}/units")
        return rows.join(done, ["sequence", "gof_id"], "left_semi").select("sequence", "gof_id", "unit_seq", "unit_type", "payload")

    def late(self) -> DataFrame:
        """(sequence, gof_id, frames, batch_id) of frames that came after their group was closed."""
        if not scratch.exists(self.spark, f"{self.out}/late"):
            return self.spark.createDataFrame([], "sequence string, gof_id long, frames array<long>, batch_id long")
        return self.spark.read.schema("sequence string, gof_id long, frames array<long>, batch_id long").parquet(f"{self.out}/late")
