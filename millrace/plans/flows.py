"""Declared tables: functions of other tables with checks, built in the order of their dependencies, as batch or stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.quality import Expectation


@dataclass(frozen=True)
class Declared:
    name: str
    make: Callable[..., DataFrame]
    reads: tuple[str, ...]
    drop: tuple[Expectation, ...] = ()
    fail: tuple[Expectation, ...] = ()


@dataclass
class Flow:
    """Tables by name. Sources are tables too, of functions without inputs."""

    declared: dict[str, Declared] = field(default_factory=dict)

    def table(self, reads: tuple[str, ...] = (), name: str | None = None, drop: tuple[Expectation, ...] = (), fail: tuple[Expectation, ...] = ()) -> Callable:
        """Declares the table that a function makes of the tables `reads`: rows that break a check of `drop` are left out, one of `fail` ends the query."""

        def add(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            own = name or make.__name__
            if own in self.declared:
                raise ValueError(f"table {own} is declared twice")
            self.declared[own] = Declared(own, make, tuple(reads), tuple(drop), tuple(fail))
            return make

        return add

    def order(self) -> list[str]:
        """Names in an order in which each table comes after those it reads; a cycle or an unknown name is a ValueError."""
        unknown = {r for d in self.declared.values() for r in d.reads} - self.declared.keys()
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        return list(TopologicalSorter({n: d.reads for n, d in self.declared.items()}).static_order())

    def build(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The plans of all tables; nothing runs yet. Streams stay streams."""
        built: dict[str, DataFrame] = {}
        for name in self.order():
            d = self.declared[name]
            rows = d.make(*[built[r] for r in d.reads]) if d.reads else d.make(spark)
            for e in d.drop:
                rows = rows.filter(e.holds())
            for e in d.fail:
                broken = F.raise_error(F.lit(f"{name}: {e.name} does not hold")).cast("boolean")
                rows = rows.filter(F.when(e.holds(), F.lit(True)).otherwise(broken))
            built[name] = rows
        return built

    def write(self, spark: SparkSession, folder: str) -> dict[str, str]:
        """Writes every batch table as parquet and gives the paths; tables that others read are read back from there."""
        paths: dict[str, str] = {}
        for name in self.order():
            d = self.declared[name]
            inner = Flow({name: Declared(name, d.make if not d.reads else (lambda s, d=d: d.make(*[s.read.parquet(paths[r]) for r in d.reads])), (), d.drop, d.fail)})
            paths[name] = f"{folder}/{name}"
            inner.build(spark)[name].write.mode("overwrite").parquet(paths[name])
        return paths
