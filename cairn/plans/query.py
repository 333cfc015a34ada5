"""Fact queries: predicates and grouping, their canonical form, freshness, and saved views."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import facts as ops


@dataclass(frozen=True)
class Query:
    """Values within a dimension are alternatives; dimensions all hold. Ranges include min and exclude max.

    A row with an unknown value meets no predicate on it. Rows of unknown continuity are left out unless
    include_incomplete is set.
    """

    uid: tuple[int, ...] = ()
    gid: tuple[int, ...] = ()
    year: tuple[int, ...] = ()
    svm: tuple[str, ...] = ()
    volume: tuple[str, ...] = ()
    path_group: tuple[str, ...] = ()
    residency: tuple[str, ...] = ()
    identity_continuity: tuple[str, ...] = ()
    creation_basis: tuple[str, ...] = ()
    size_min: int | None = None
    size_max: int | None = None
    created_min: datetime | None = None
    created_max: datetime | None = None
    include_incomplete: bool = False
    group_by: tuple[str, ...] = ()
    require_current: bool = field(default=False, compare=False)
    allow_stale: bool = field(default=False, compare=False)

    SETS = ("uid", "gid", "year", "svm", "volume", "path_group", "residency", "identity_continuity", "creation_basis")

    def validate(self) -> Query:
        for lo, hi in ((self.size_min, self.size_max), (self.created_min, self.created_max)):
            if lo is not None and hi is not None and lo >= hi:
                raise ValueError(f"empty range: {lo} to {hi}")
        unknown = set(self.group_by) - set(ops.DIMENSIONS)
        if unknown or len(set(self.group_by)) < len(self.group_by):
            raise ValueError(f"bad grouping: {', '.join(self.group_by)}")
        if self.require_current and self.allow_stale:
            raise ValueError("require_current and allow_stale exclude each other")
        return self

    def predicates(self) -> str:
        """Canonical JSON of all but grouping and freshness."""
        parts = {k: sorted(set(v)) if isinstance(v, tuple) else v for k, v in asdict(self).items() if k not in ("group_by", "require_current", "allow_stale")}
        return json.dumps(parts, sort_keys=True, default=str)

    def canonical(self) -> str:
        return json.dumps({"where": self.predicates(), "by": sorted(self.group_by)}, sort_keys=True)

    def key(self, version: object) -> str:
        return hashlib.sha256(f"{version}\n{self.canonical()}".encode()).hexdigest()

    def condition(self) -> Column:
        out = F.lit(True)
        for name in self.SETS:
            if values := getattr(self, name):
                out = out & F.col(name).isin(*values)
        for name, lo, hi in (("logical_size", self.size_min, self.size_max), ("created_at", self.created_min, self.created_max)):
            if lo is not None:
                out = out & (F.col(name) >= F.lit(lo))
            if hi is not None:
                out = out & (F.col(name) < F.lit(hi))
        if not self.include_incomplete:
            out = out & (F.col("identity_continuity") != "unknown")
        return out

    def run(self, facts: DataFrame) -> DataFrame:
        self.validate()
        return ops.grouped(facts.filter(self.condition()), list(self.group_by))

    def explain(self, facts: DataFrame) -> DataFrame:
        """How many rows match, and how many fall out for unknown continuity or values."""
        known = replace(self, include_incomplete=True).condition()
        return facts.agg(
            F.count_if(self.condition()).cast("long").alias("matched"),
            F.count_if(known & (F.col("identity_continuity") == "unknown")).cast("long").alias("left_out_continuity") if not self.include_incomplete else F.lit(0).cast("long").alias("left_out_continuity"),
            F.count_if(known.isNull()).cast("long").alias("undecided"),
        )


class StaleError(RuntimeError):
    """The facts lag behind the source and the query does not allow it."""


def check_freshness(query: Query, applied: int, head: int | None) -> str:
    """'current', 'stale' or 'unknown' (no head to compare with). Any lag is refused unless the query allows it; one that
    requires current facts needs a head."""
    if head is None:
        if query.require_current:
            raise StaleError("the head of the source is not known")
        return "unknown"
    if applied < head and not query.allow_stale:
        raise StaleError(f"facts are at commit {applied}, the source is at {head}: allow stale facts or catch up")
    return "stale" if applied < head else "current"


def save_view(query: Query, facts: DataFrame, path: str) -> DataFrame:
    """Writes the groups of a query as a table that coarser queries can be answered from."""
    query.run(facts).write.mode("overwrite").parquet(path)
    return facts.sparkSession.read.parquet(path)


def from_view(query: Query, saved: Query, view: DataFrame) -> DataFrame:
    """The answer from a saved view with the same predicates and all of the query's dimensions; others are refused."""
    if saved.predicates() != query.validate().predicates() or not set(query.group_by) <= set(saved.group_by):
        raise ValueError(f"the view of {saved.canonical()} does not answer {query.canonical()}")
    return ops.roll_up(view, list(query.group_by))
