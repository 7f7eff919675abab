"""Workflows as declared steps over DataFrames: conditional edges, one place for errors, results that survive.

A step names where its inputs come from and, if only some rows go that way, the
condition. Rows that a step marks with an ``error`` leave the flow there and meet in
the error step. What several steps read is written once into the workflow's folder;
a run that finds it there, whole, reads it instead of doing the work again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edge:
    """Rows of a step or source, all of them or those for which ``when`` is true."""

    source: str
    when: Column | None = None


@dataclass(frozen=True)
class Step:
    """``run`` gets a DataFrame for every name in ``inputs``. ``keep`` writes the result even if one step reads it."""

    name: str
    run: Callable[..., DataFrame]
    inputs: dict[str, str | Edge] = field(default_factory=dict)
    keep: bool = False

    def edges(self) -> dict[str, Edge]:
        return {k: e if isinstance(e, Edge) else Edge(e) for k, e in self.inputs.items()}


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


class Workflow:
    """Steps in any order; ``error`` is the input name under which a step gets all errors: (step, error, row as JSON)."""

    ERRORS = "errors"

    def __init__(self, *steps: Step):
        self.steps = {s.name: s for s in steps}
        if len(self.steps) < len(steps):
            raise ValueError("two steps have one name")

    def _order(self, sources: dict[str, DataFrame]) -> list[Step]:
        needs = {s.name: {e.source for e in s.edges().values()} for s in self.steps.values()}
        unknown = {n for of in needs.values() for n in of} - needs.keys() - sources.keys() - {self.ERRORS}
        if unknown:
            raise ValueError(f"no step or source is named {sorted(unknown)}")
        before = [n for n, of in needs.items() if self.ERRORS not in of]
        order = TopologicalSorter({n: [x for x in of if x in needs] + (before if self.ERRORS in of else []) for n, of in needs.items()})
        return [self.steps[n] for n in order.static_order()]

    def run(self, spark: SparkSession, sources: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
        """The result of every step. ``folder`` must be one that all executors share, and another for other sources."""
        readers = Counter(e.source for s in self.steps.values() for e in s.edges().values())
        known, errors = dict(sources), None
        for step in self._order(sources):
            handles = self.ERRORS in {e.source for e in step.edges().values()}
            if handles:
                known[self.ERRORS] = errors if errors is not None else spark.createDataFrame([], "step string, error string, row string")
            path = f"{folder}/{step.name}"
            given = {k: known[e.source] if e.when is None else known[e.source].where(e.when) for k, e in step.edges().items()}
            result = None
            if step.keep or readers[step.name] > 1:
                if not _whole(spark, path):
                    step.run(**given).write.mode("overwrite").parquet(path)
                result = spark.read.parquet(path)
            else:
                result = step.run(**given)
            if "error" in result.columns and not handles:
                bad = result.where("error is not null")
                bad = bad.select(F.lit(step.name).alias("step"), "error", F.to_json(F.struct(*[c for c in result.columns if c != "error"])).alias("row"))
                errors = bad if errors is None else errors.unionByName(bad)
                result = result.where("error is null").drop("error")
            known[step.name] = result
        return {n: known[n] for n in self.steps}
