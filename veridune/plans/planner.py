"""Detectors as plug-ins, a plan that covers the wanted classes cheaply, and the state of its results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Detector:
    name: str
    covers: frozenset[str]
    run: Callable[[SparkSession, str], DataFrame]
    needs: frozenset[str] = frozenset()
    cost: float = 1.0
    emits: str = "p"

    def __post_init__(self):
        if self.emits not in ("p", "e", "statistic") or self.cost < 0 or not self.covers:
            raise ValueError(f"{self.name}: not a detector")


@dataclass
class Registry:
    detectors: dict[str, Detector] = field(default_factory=dict)

    def add(self, d: Detector) -> None:
        if d.name in self.detectors:
            raise ValueError(f"{d.name} is there already")
        self.detectors[d.name] = d

    def ineligible(self, d: Detector, access: set[str], wanted: set[str], budget: float) -> str | None:
        """The first rule that turns it away."""
        return "ACCESS" if not d.needs <= access else "NO_CLASS" if not d.covers & wanted else "COST" if d.cost > budget else None

    def plan(self, access: set[str], wanted: dict[str, float], budget: float) -> list[str]:
        """The subset within budget of greatest covered weight, then breadth, then least cost; exact up to 16 detectors, greedy above."""
        ok = [d for d in self.detectors.values() if not self.ineligible(d, access, set(wanted), budget)]
        worth = lambda s: (sum(w for c, w in wanted.items() if any(c in d.covers for d in s)), len(set().union(*[d.covers for d in s])) if s else 0, -sum(d.cost for d in s))
        if len(ok) <= 16:
            sets = [s for n in range(len(ok) + 1) for s in combinations(ok, n) if sum(d.cost for d in s) <= budget]
            return sorted(d.name for d in max(sets, key=worth))
        got: list[Detector] = []
        while True:
            more = [d for d in ok if d not in got and sum(x.cost for x in [*got, d]) <= budget]
            best = max(more, key=lambda d: worth([*got, d]), default=None)
            if best is None or worth([*got, best])[0] <= worth(got)[0]:
                return sorted(d.name for d in got)
            got.append(best)

    def execute(self, spark: SparkSession, sf_dir: str, names: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
        """Results by name and (name, status, detail): a detector that raises is EXECUTION_ERROR and stops nothing."""
        out, rows = {}, []
        for n in names:
            try:
                out[n] = self.detectors[n].run(spark, sf_dir)
                rows.append((n, "RAN", ""))
            except Exception as e:  # the plug-in border: whatever it raises is its result
                rows.append((n, "EXECUTION_ERROR", f"{type(e).__name__}: {e}"[:500]))
        return out, spark.createDataFrame(rows, "name string, status string, detail string")


def completeness(status: DataFrame, required: list[str]) -> DataFrame:
    """(fraction, blocking, accept_permitted) of required detectors that ran."""
    need = status.sparkSession.createDataFrame([(r,) for r in required], "name string").join(status, "name", "left")
    g = need.agg(F.avg((F.coalesce("status", F.lit("")) == "RAN").cast("double")).alias("fraction"), F.array_sort(F.collect_list(F.when(F.coalesce("status", F.lit("")) != "RAN", F.col("name")))).alias("blocking"))
    return g.withColumn("accept_permitted", F.size("blocking") == 0)
