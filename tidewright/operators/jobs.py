"""Running named steps in the order of their needs, with timings and markers."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def logger(name: str, level: int = logging.INFO) -> logging.Logger:
    """The driver's log of that name: one handler, with times in UTC, however often it is asked for."""
    found = logging.getLogger(f"tidewright.{name}")
    if not found.handlers:
        shown = logging.Formatter("%(asctime)sZ %(levelname)s %(name)s %(message)s", "%Y-%m-%dT%H:%M:%S")
        shown.converter = time.gmtime
        found.addHandler(logging.StreamHandler())
        found.handlers[0].setFormatter(shown)
        found.propagate = False
    found.setLevel(level)
    return found


@dataclass
class Job:
    """A step: what it needs, what it does, and whether its output is there already."""

    name: str
    run: Callable[[], object]
    needs: list[str] = field(default_factory=list)
    done: Callable[[], bool] = lambda: False


def order(jobs: list[Job], wanted: list[str]) -> list[Job]:
    """The wanted jobs and all that they need, each once and after its needs."""
    by_name, out, path = {j.name: j for j in jobs}, [], []

    def visit(name: str) -> None:
        if name in path:
            raise ValueError(f"{' > '.join([*path, name])} goes round")
        if name not in by_name:
            raise KeyError(name)
        if by_name[name] in out:
            return
        path.append(name)
        for need in by_name[name].needs:
            visit(need)
        path.pop()
        out.append(by_name[name])

    for name in wanted:
        visit(name)
    return out


def run(jobs: list[Job], wanted: list[str], force: bool = False, dry: bool = False) -> list[tuple[str, str, float]]:
    """(name, status, seconds) of each job: planned, skipped, done or failed; a failure ends the run."""
    out = []
    for job in order(jobs, wanted):
        began = time.monotonic()
        if dry:
            out.append((job.name, "planned", 0.0))
        elif not force and job.done():
            out.append((job.name, "skipped", 0.0))
        else:
            try:
                job.run()
            except Exception:
                out.append((job.name, "failed", time.monotonic() - began))
                raise
            out.append((job.name, "done", time.monotonic() - began))
    return out


def timings(spark: SparkSession, rows: list[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, status string, seconds double")


def sections(df: DataFrame, named: dict[str, Callable[[DataFrame], DataFrame]], wanted: list[str] | None = None) -> dict[str, DataFrame]:
    """Reports by section over one table; unknown names raise."""
    wanted = wanted or list(named)
    if unknown := [w for w in wanted if w not in named]:
        raise ValueError(f"unknown sections {unknown}; there are {sorted(named)}")
    return {w: named[w](df) for w in wanted}


def best_checkpoint(df: DataFrame, metric: str = "macro_f1", patience: int | None = None) -> DataFrame:
    """The epoch with the largest metric, the first of equals; with patience, of the epochs before training would stop."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    if patience is not None:
        # A run's epochs are few and ordered: one window over them.
        before = W.orderBy("epoch").rowsBetween(W.unboundedPreceding, W.currentRow)
        best_so_far = F.max(F.struct(F.col(metric), (-F.col("epoch")).alias("e"))).over(before)
        df = df.withColumn("_since", F.col("epoch") + best_so_far["e"])
        stopped = F.max((F.col("_since") >= patience).cast("int")).over(W.orderBy("epoch").rowsBetween(W.unboundedPreceding, -1))
        df = df.withColumn("_stopped", F.coalesce(stopped, F.lit(0))).filter("_stopped = 0").drop("_since", "_stopped")
    return df.orderBy(F.desc(metric), "epoch").limit(1)
