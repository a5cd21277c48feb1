"""The whole inspection as one lazy plan over many windows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import anomalies as A
from pulseframe.operators import baseline as B
from pulseframe.operators import clusters as CL
from pulseframe.operators import graph as G
from pulseframe.operators import paths as P
from pulseframe.operators import rollups as R
from pulseframe.operators import rules, score, stats
from pulseframe.operators.facts import series_base
from pulseframe.operators.windows import assign_windows
from pulseframe.policy import Policy
from pulseframe.schemas import RKEY
from pulseframe.session import write_stage
from pulseframe.sources.points import scan_windows


@dataclass
class Inspection:
    """Stages of an inspection, each built on first use.

    When `staged`, the results that several branches read are written once: clean points,
    baselines, series facts, findings and what follows from them. Besides surviving executor
    loss this keeps each plan small; a single plan over all rules would be re-optimised after
    every one of its many exchanges. The archive is only read where baselines are built.
    """

    points: DataFrame
    archive: DataFrame
    windows: DataFrame
    policy: Policy
    min_samples: int | None = None
    staged: bool = True
    failed_rules: list[tuple[str, str]] = field(default_factory=list)

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return write_stage(df, name) if self.staged else df

    @cached_property
    def services(self) -> DataFrame:
        return self.policy.service_dim(self.windows.sparkSession)

    @cached_property
    def edges(self) -> DataFrame:
        return G.edges(self.services)

    @cached_property
    def graph(self) -> P.Condensed:
        """Layers of the dependency graph, with a longest path of every service."""
        return P.condense(self.edges, self.services.select(F.col("service").alias("node")))

    @cached_property
    def longest(self) -> DataFrame:
        return self.graph.nodes.select(F.col("node").alias("head"), "path")

    @cached_property
    def related(self) -> DataFrame:
        """Pairs of the affected services and what they depend on or is upstream of them: src, dst, hops, path."""
        hit = self._stage(self.active.select(F.col("service").alias("node")).distinct(), "affected")
        return P.reach(self.edges, hit).unionByName(P.reach(self.edges, hit, upstream=True)).distinct()

    @cached_property
    def closure(self) -> DataFrame:
        """All related pairs of the topology; the inspection itself needs only `related`."""
        return P.reach(self.edges, self.services.select(F.col("service").alias("node")))

    @cached_property
    def clean(self) -> DataFrame:
        """The points that the windows, the rules' lookbacks and, of a shared input, the archives need."""
        span = self.policy.max_lookback_seconds(0)
        start = F.least(F.col("window_start"), F.timestamp_seconds(F.unix_seconds("window_end") - span))
        end = F.col("window_end")
        if self.archive is self.points:
            start, end = F.least(start, F.col("archive_start")), F.greatest(end, F.col("archive_end"))
        return self._stage(scan_windows(self.points, self.windows, start, end), "clean")

    @cached_property
    def windowed(self) -> DataFrame:
        w = self.windows.select("run_id", "window_start", "window_end")
        return stats.window_series(assign_windows(self.clean, w), RKEY)

    @cached_property
    def baselines(self) -> DataFrame:
        archive = self.clean
        if self.archive is not self.points:
            archive = scan_windows(self.archive, self.windows, F.col("archive_start"), F.col("archive_end"))
        return self._stage(B.baselines(archive, self.windows, self.policy, self.min_samples), "baselines")

    @cached_property
    def facts(self) -> DataFrame:
        return self._stage(series_base(self.windowed, self.baselines, self.policy), "facts")

    @cached_property
    def rule_inputs(self) -> rules.Inputs:
        return rules.Inputs(self.windowed, self.baselines, self.clean, self.windows, None, self.policy, self.facts, self.graph)

    @cached_property
    def findings(self) -> DataFrame:
        df, self.failed_rules = rules.all_findings(self.rule_inputs)
        return self._stage(df, "findings")

    @cached_property
    def anomalies(self) -> DataFrame:
        return self._stage(A.aggregate(self.findings, self.services), "anomalies")

    @cached_property
    def active(self) -> DataFrame:
        return self.anomalies.where(~F.col("is_suppressed"))

    @cached_property
    def grouped(self) -> DataFrame:
        """Active anomalies with their cluster key and role."""
        return self._stage(CL.assign(self.active, self.related, self.services, edges=self.edges), "grouped")

    @cached_property
    def clusters(self) -> DataFrame:
        return self._stage(CL.clusters(self.grouped, self.related, self.longest), "clusters")

    @cached_property
    def members(self) -> DataFrame:
        """Active anomalies with cluster ids and the primary flag."""
        return CL.members(self.grouped, self.clusters)

    @cached_property
    def service_stats(self) -> DataFrame:
        return R.service_stats(self.active, self.clusters, self.windows, self.services)

    @cached_property
    def score(self) -> DataFrame:
        return score.totals(score.breakdown(self.active, self.windows, self.policy), self.active, self.windows, self.policy)


def inspect(points: DataFrame, archive: DataFrame, windows: DataFrame, policy: Policy, **options) -> Inspection:
    """Inspect every window over clean `points`, with baselines from `archive`.

    windows: run_id, scenario_id, window_start, window_end, archive_start, archive_end.
    """
    return Inspection(points, archive, windows, policy, **options)
