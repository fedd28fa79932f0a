"""Command line: python -m riftspark.cli {network,validate,snap,info} ..."""

from __future__ import annotations

import argparse
import json
import platform
import sys

import pyspark
from pyspark.sql import SparkSession

from riftspark.operators import grid, topology, validate
from riftspark.plans.network import Network, Validation
from riftspark.sources import vector

AREA_RULES = ("TRACE UNDERLAPS TARGET AREA",)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riftspark")
    commands = p.add_subparsers(dest="command", required=True)
    n = commands.add_parser("network", help="describe the network of traces in areas and write its tables")
    v = commands.add_parser("validate", help="validate traces and write them with their errors")
    s = commands.add_parser("snap", help="snap the ends of traces")
    for c in (n, v, s):
        c.add_argument("traces")
        c.add_argument("--snap", type=float, default=0.001)
        c.add_argument("--output", required=True)
    for c in (n, v):
        c.add_argument("areas")
    n.add_argument("--circular", action="store_true")
    n.add_argument("--keep-whole", action="store_true", help="don't clip traces to the areas")
    n.add_argument("--name", help="the network's name; that of the file of traces, if not given")
    n.add_argument("--no-topology", action="store_true", help="don't determine branches and nodes")
    n.add_argument("--censoring", help="a file of areas in which traces can't be seen")
    v.add_argument("--no-fix", action="store_true")
    v.add_argument("--only-areas", action="store_true", help="look only for traces that end just before the area's boundary")
    v.add_argument("--no-empty", action="store_true", help="an area without traces is an error")
    for c in (n, v, s):
        c.add_argument("--layer", help="the layer of traces, where a file has several")
    for c in (n, v):
        c.add_argument("--area-layer", help="the layer of areas")
    s.add_argument("--rounds", type=int, default=10)
    commands.add_parser("info", help="versions as JSON")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "info":
        print(json.dumps({"python": platform.python_version(), "pyspark": pyspark.__version__}))
        return 0
    spark = SparkSession.builder.appName("riftspark").getOrCreate()
    name = getattr(a, "name", None) or vector.plain_stem(a.traces)
    traces = vector.check_not_empty(vector.read_traces(spark, a.traces, name, layer=a.layer), a.traces)
    if a.command == "snap":
        lines = traces.where("pts is not null").select("trace_id", "network", "pts")
        done = topology.snap_traces(lines, max(grid.median_length(grid.segments_of(lines)), a.snap), a.snap, allowed=a.rounds)
        vector.write_collection(done, a.output)
        return 0
    areas = vector.check_not_empty(vector.read_areas(spark, a.areas, name, layer=a.area_layer), a.areas)
    if a.command == "validate":
        checked = Validation(traces, areas, validate.Thresholds(snap=a.snap), fix=not a.no_fix).run(AREA_RULES if a.only_areas else validate.ERRORS, not a.no_empty)
        vector.write_collection(checked, a.output)
        validate.summary(checked).orderBy("error").show(20, False)
        return 0
    unseen = vector.read_areas(spark, a.censoring, name) if a.censoring else None
    net = Network(traces.where("pts is not null").drop("parts"), areas, a.snap, a.circular, not a.keep_whole, censoring=unseen)
    net.parameters(not a.no_topology).show(vertical=True, truncate=False)
    vector.write_tables(net.tables(not a.no_topology), a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
