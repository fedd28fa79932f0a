"""Networks of traces: the tables and results of one or many networks, planned lazily.

Many networks are one table with a column network; everything below computes all of them at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riftspark.functions import geom
from riftspark.functions.lineage import cut
from riftspark.operators import grid, joins, lengths, overlay, params, sampling, topology, validate

#: Default azimuth sets: names and ranges in degrees.
AZIMUTH_SETS = (("1", "2", "3"), ((0.0, 60.0), (60.0, 120.0), (120.0, 180.0)))


class Network:
    """Traces (trace_id, network, pts, ...) in areas (area_id, network, rings), with derived columns and aggregates.

    circular: areas are circles, so that lines are weighted by how often they meet the boundary and the Mauldon
    estimates are defined. truncate: clip the traces to the areas.
    """

    def __init__(
        self, traces: DataFrame, areas: DataFrame, snap: float = 0.001, circular: bool = False, truncate: bool = True, branches: DataFrame | None = None, nodes: DataFrame | None = None,
        azimuth_sets: tuple[Sequence[str], Sequence[tuple[float, float]]] = AZIMUTH_SETS, length_sets: tuple[Sequence[str], Sequence[tuple[float, float]]] | None = None, censoring: DataFrame | None = None, cell: float | None = None,
    ):
        self.areas, self.snap, self.circular = areas, snap, circular
        self.azimuth_sets, self.length_sets, self.censoring_areas = azimuth_sets, length_sets, censoring
        self.cell = cell or max(grid.median_length(grid.segments_of(traces)), 10 * snap)
        self._given = (branches, nodes)
        plain = traces.withColumn("pts", geom.drop_z("pts"))
        if truncate:
            parts = overlay.clip(plain, areas, self.cell)
            plain = parts.withColumn("source_id", F.col("trace_id")).withColumn("trace_id", F.when(F.col("piece") == F.min("piece").over(Window.partitionBy("trace_id")), F.col("trace_id")).otherwise(-F.abs(F.xxhash64("trace_id", "piece")))).drop("piece")
            plain = cut(plain)
        self._plain = plain

    @cached_property
    def traces(self) -> DataFrame:
        """Traces with length_raw, length (weighted), azimuth, azimuth_set and, if configured, length_set."""
        return self._derived(self._plain, self.trace_crossings, ["trace_id"])

    @cached_property
    def trace_crossings(self) -> DataFrame:
        """(trace_id, crossings, weight): 0, 1 or 2 for circular areas, else 0."""
        if not self.circular:
            return self._plain.select("trace_id", F.lit(0).alias("crossings"), F.lit(1).alias("weight"))
        return cut(joins.boundary_counts(joins.boundary_flags(self._plain, self.areas, self.cell, self.snap)))

    @cached_property
    def _topology(self) -> tuple[DataFrame, DataFrame]:
        if self._given[0] is not None and self._given[1] is not None:
            return self._given
        branches, nodes = topology.branches_and_nodes(self._plain, self.areas, self.snap, self.cell, clipped=True)
        return cut(branches), nodes

    @property
    def nodes(self) -> DataFrame:
        return self._topology[1]

    @cached_property
    def branches(self) -> DataFrame:
        """Branches with connection and the derived columns of traces."""
        found = self._topology[0]
        n = params.branch_boundary_crossings(F.col("connection")) if self.circular else F.lit(0)
        of = found.select("trace_id", "piece", n.alias("crossings")).withColumn("weight", geom.boundary_weight(F.col("crossings")))
        return self._derived(found, of, ["trace_id", "piece"])

    def _derived(self, lines: DataFrame, crossed: DataFrame, keys: list[str]) -> DataFrame:
        out = lines.withColumn("length_raw", geom.length("pts")).withColumn("azimuth", geom.azimuth("pts")).join(crossed, keys)
        out = out.withColumn("length", F.col("length_raw") * F.col("weight"))
        out = out.withColumn("azimuth_set", geom.set_of(F.col("azimuth"), self.azimuth_sets[1], self.azimuth_sets[0], around=True))
        if self.length_sets:
            out = out.withColumn("length_set", geom.set_of(F.col("length"), self.length_sets[1], self.length_sets[0]))
        return out

    @property
    def area(self) -> DataFrame:
        """(network, area)."""
        return self.areas.groupBy("network").agg(F.sum(geom.polygon_area("rings")).alias("area"))

    @property
    def centroids(self) -> DataFrame:
        return self.areas.select("network", "area_id", geom.ring_centroid(F.col("rings")[0]).alias("c")).select("network", "area_id", "c.x", "c.y")

    @property
    def representative_points(self) -> DataFrame:
        return sampling.representative_points(self.areas)

    def parameters(self, topology: bool = True) -> DataFrame:
        """One row of parameters for each network; without topology, what needs nodes or branches is NaN."""
        raw = self.traces.select("network", F.col("length_raw").alias("length"))
        if not topology:
            return params.topology_parameters(raw, self.area, circular=self.circular)
        return params.topology_parameters(raw, self.area, self.nodes, self.branches.select("network", F.col("length_raw").alias("length")), self.circular)

    def node_counts(self) -> DataFrame:
        return params.node_counts(self.nodes)

    def branch_counts(self) -> DataFrame:
        return params.branch_counts(self.branches)

    def azimuth_set_counts(self, branches: bool = False) -> DataFrame:
        return params.set_table(self.branches if branches else self.traces, "azimuth_set", self.azimuth_sets[0])

    def length_set_counts(self, branches: bool = False) -> DataFrame:
        if not self.length_sets:
            raise AttributeError("no length sets are configured")
        return params.set_table(self.branches if branches else self.traces, "length_set", self.length_sets[0])

    def rose(self, branches: bool = False) -> DataFrame:
        return params.rose(self.branches if branches else self.traces)

    def anisotropy(self) -> DataFrame:
        return params.anisotropy(self.branches)

    def xyi_points(self) -> DataFrame:
        return params.ternary(self.node_counts(), ("X", "Y", "I"))

    def branch_points(self) -> DataFrame:
        return params.ternary(self.branch_counts(), ("C-C", "C-I", "I-I"))

    def azimuth_relations(self) -> DataFrame:
        return params.relations(self.traces, self.nodes, "azimuth_set", self.azimuth_sets[0], 0.001, self.cell)

    def length_relations(self) -> DataFrame:
        if not self.length_sets:
            raise AttributeError("no length sets are configured")
        return params.relations(self.traces, self.nodes, "length_set", self.length_sets[0], 0.001, self.cell)

    def length_distribution(self, branches: bool = False, azimuth_set: str | None = None, normalised: bool = False) -> DataFrame:
        lines = self.branches if branches else self.traces
        if azimuth_set is not None:
            lines = lines.where(F.col("azimuth_set") == azimuth_set)
        return lengths.ccm(lines, areas=self.area if normalised else None)

    def powerlaw_fit(self, branches: bool = False, xmin: float | None = None) -> DataFrame:
        return lengths.powerlaw_fit(self.branches if branches else self.traces, xmin=xmin)

    def fit_description(self, branches: bool = False, xmin: float | None = None) -> DataFrame:
        lines = self.branches if branches else self.traces
        return lengths.describe_fits(lines, lengths.powerlaw_fit(lines, xmin=xmin))

    def fits_by_set(self, branches: bool = False) -> DataFrame:
        """The automatic fit of each azimuth set of each network."""
        return lengths.powerlaw_fit(self.branches if branches else self.traces, by=("network", "azimuth_set"))

    def contour_grid(self, width: float | None = None, precursor: DataFrame | None = None) -> DataFrame:
        return sampling.contour_grid(self._plain, width, self.nodes, self.branches, precursor)

    def subsample(self, samples: int, least_radius: float, by_area: bool = False, seed: int = 0) -> DataFrame:
        """Parameters of random circles inside circular areas."""
        circles = self.centroids.join(self.area, "network").select("network", "x", "y", geom.circle_radius(F.col("area")).alias("r"))
        return sampling.subsample(self._plain, circles, samples, least_radius, self.nodes, self.branches, by_area, seed)

    def sample_networks(self, samples: int, least_radius: float, by_area: bool = False, seed: int = 0) -> Network:
        """Random circles inside circular areas, each a network of its own with its own clip, topology, weights and fits; their
        names are network/number."""
        circles = self.centroids.join(self.area, "network").select("network", "x", "y", geom.circle_radius(F.col("area")).alias("r"))
        circles = cut(sampling.random_circles(circles, samples, least_radius, by_area, seed))
        traces, areas = sampling.sample_networks(self._plain, circles, max(self.cell, 2 * least_radius))
        return Network(traces, areas, self.snap, True, True, azimuth_sets=self.azimuth_sets, length_sets=self.length_sets, cell=self.cell)

    def censoring(self) -> DataFrame:
        """(network, censoring): the area of censoring polygons inside the target areas; NaN without such polygons."""
        if self.censoring_areas is None:
            return self.area.select("network", F.lit(float("nan")).alias("censoring"))
        found = overlay.polygon_overlaps(self.censoring_areas, self.areas)
        return self.area.select("network").join(found, "network", "left").select("network", F.coalesce("area", F.lit(0.0)).alias("censoring"))

    def description(self) -> DataFrame:
        """Parameters, counts, boundary counts, fits and censoring: one wide row for each network."""
        prefixed = lambda df, p: df.select("network", *[F.col(f"`{c}`").alias(f"{p} {c}") for c in df.columns if c != "network"])
        out = self.parameters()
        for more in (
            self.node_counts(), self.branch_counts(), params.crossing_counts(self.traces, "Trace"), params.crossing_counts(self.branches, "Branch"), prefixed(self.fit_description(), "trace"),
            prefixed(self.fit_description(True), "branch"), self.censoring().withColumnRenamed("censoring", "Censoring"),
        ):
            out = out.join(more, "network", "left")
        radius = geom.circle_radius(F.col("Area")) if self.circular else F.lit(float("nan"))
        return out.withColumn("Radius", radius).withColumn("Relative Censoring", F.col("Censoring") / F.col("Area"))

    def tables(self, topology: bool = True) -> dict[str, DataFrame]:
        """What an export holds; without topology, what doesn't need nodes or branches."""
        if not topology:
            parameters = self.parameters(False).join(self.censoring().withColumnRenamed("censoring", "__c"), "network", "left").withColumn("Censoring", F.col("__c")).drop("__c")
            return {"traces": self.traces, "parameters": parameters, "trace_rose": self.rose(), "trace_fits": self.fit_description()}
        return {
            "traces": self.traces, "branches": self.branches, "nodes": self.nodes, "parameters": self.description(), "azimuth_relations": self.azimuth_relations(), "trace_rose": self.rose(),
            "branch_rose": self.rose(True), "anisotropy": self.anisotropy(), "xyi": self.xyi_points(), "branch_classes": self.branch_points(),
        }


class MultiNetwork:
    """Results over several networks of one table."""

    def __init__(self, network: Network):
        self.network = network

    def multi_scale_fit(self, branches: bool = False, cut_offs: DataFrame | None = None) -> DataFrame:
        lines = self.network.branches if branches else self.network.traces
        return lengths.multi_scale_fit(lines, self.network.area, cut_offs)

    def optimised_cut_offs(self, branches: bool = False) -> DataFrame:
        return lengths.optimised_cut_offs(self.network.branches if branches else self.network.traces, self.network.area)

    def own_cut_offs(self, branches: bool = False) -> DataFrame:
        """The joint straight line with a cut-off of its own for each network."""
        return lengths.own_cut_offs(self.network.branches if branches else self.network.traces, self.network.area)

    def set_fits(self, branches: bool = False) -> DataFrame:
        """The joint straight line of each azimuth set over all networks."""
        lines = self.network.branches if branches else self.network.traces
        by = ["network", "azimuth_set"]
        areas = self.network.area.withColumn("azimuth_set", F.explode(F.array(*map(F.lit, self.network.azimuth_sets[0]))))
        return lengths.loglog_fit(lengths.ccm(lines, by, areas), ["azimuth_set"])

    def compared(self, names: Sequence[str], parameters: Sequence[str]) -> DataFrame:
        """Parameters as rows, networks as columns."""
        return params.as_columns(self.network.parameters(), names, parameters)

    def subsample(self, samples: int, least_radius: float, by_area: bool = False, seed: int = 0) -> DataFrame:
        return self.network.subsample(samples, least_radius, by_area, seed)


class Validation:
    """A validation of traces in areas."""

    def __init__(self, traces: DataFrame, areas: DataFrame | None, thresholds: validate.Thresholds | None = None, fix: bool = True, cell: float | None = None):
        self.traces, self.areas, self.fix, self.cell = traces, areas, fix, cell
        self.thresholds = thresholds or validate.Thresholds()

    def run(self, rules: Sequence[str] = validate.ERRORS, allow_empty: bool = True) -> DataFrame:
        """traces with their errors; allow_empty: else an area without traces is an error."""
        if not allow_empty and self.areas is not None:
            lines = self.traces.where("pts is not null")
            if joins.empty_area(lines, self.areas, self.cell or grid.median_length(grid.segments_of(lines))):
                raise ValueError("EMPTY TARGET AREA: no trace meets the areas")
        return validate.validated(self.traces, self.areas, self.cell, self.thresholds, rules, self.fix)
