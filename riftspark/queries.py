"""Registered queries of the trace operators over the driver's tables, and their SQL for DuckDB.

Doubles are rounded to six places where two engines may sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftspark.functions import geom
from riftspark.operators import grid, joins, lengths, overlay, params, sampling, topology, validate
from riftspark.sources import views
from riftspark.sources.views import EMBEDDINGS_SQL, ORDERS_SQL

#: The orders view: its cell size, and a box that many of its segments cross.
CELL = 16.0
BOX = (128.0, 128.0, 640.0, 768.0)
SETS = (("1", "2", "3"), ((0.0, 60.0), (60.0, 120.0), (120.0, 180.0)))
LENGTH_SETS = (("short", "middle", "long"), ((0.0, 4.0), (4.0, 8.0), (8.0, 100.0)))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _measured(traces: DataFrame) -> DataFrame:
    return traces.withColumn("length", geom.length("pts")).withColumn("azimuth", geom.azimuth("pts"))


_LENGTH = "sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0))"
_AZ = "(CASE WHEN 90.0-degrees(atan2(y1-y0,x1-x0)) < 0 THEN 90.0-degrees(atan2(y1-y0,x1-x0))+360.0 ELSE 90.0-degrees(atan2(y1-y0,x1-x0)) END)"
_HALF = f"(CASE WHEN {_AZ} >= 180 THEN {_AZ}-180.0 ELSE {_AZ} END)"
_MEASURED = f"m AS (SELECT *, {_LENGTH} AS len, {_HALF} AS az FROM l)"
_SET = "CASE WHEN az BETWEEN 0 AND 60 THEN '1' WHEN az BETWEEN 60 AND 120 THEN '2' WHEN az BETWEEN 120 AND 180 THEN '3' ELSE '-1' END"


@query(f"WITH {ORDERS_SQL}, {_MEASURED} SELECT {_SET} AS azimuth_set, count(*) AS n, round(sum(len), 6) AS total, round(min(len), 6) AS least, round(max(len), 6) AS greatest FROM m GROUP BY 1")
def azimuth_set_summary(spark, sf_dir):
    """Lines by azimuth set."""
    m = _measured(views.order_traces(spark, sf_dir)).withColumn("azimuth_set", geom.set_of(F.col("azimuth"), SETS[1], SETS[0], around=True))
    return m.groupBy("azimuth_set").agg(F.count("*").alias("n"), r6(F.sum("length")).alias("total"), r6(F.min("length")).alias("least"), r6(F.max("length")).alias("greatest"))


@query(f"WITH {EMBEDDINGS_SQL}, {_MEASURED} SELECT id AS trace_id, round(len, 6) AS length, round(az, 6) AS azimuth, round({_AZ}, 6) AS direction FROM m")
def trace_length_azimuth(spark, sf_dir):
    t = views.embedding_traces(spark, sf_dir)
    return t.select("trace_id", r6(geom.length("pts")).alias("length"), r6(geom.azimuth("pts")).alias("azimuth"), r6(geom.azimuth("pts", False)).alias("direction"))


@query(f"WITH {EMBEDDINGS_SQL} SELECT id AS trace_id, round((x1-x0)/{_LENGTH}, 6) AS ux, round((y1-y0)/{_LENGTH}, 6) AS uy FROM l")
def unit_vectors(spark, sf_dir):
    t = views.embedding_traces(spark, sf_dir).withColumn("u", geom.unit_vector(geom.start("pts"), geom.end("pts")))
    return t.select("trace_id", r6("u.x").alias("ux"), r6("u.y").alias("uy"))


_POLY = "p AS (SELECT vec_id AS id, label::VARCHAR AS grp, " + ", ".join(f"embedding[{2 * k + 1}]::DOUBLE AS x{k}, embedding[{2 * k + 2}]::DOUBLE AS y{k}" for k in range(5)) + " FROM embeddings)"
_POLY_LEN = " + ".join(f"sqrt((x{k + 1}-x{k})*(x{k + 1}-x{k})+(y{k + 1}-y{k})*(y{k + 1}-y{k}))" for k in range(4))


@query(f"WITH {_POLY} SELECT id AS trace_id, round({_POLY_LEN}, 6) AS length, least(x0,x1,x2,x3,x4) AS min_x, least(y0,y1,y2,y3,y4) AS min_y, greatest(x0,x1,x2,x3,x4) AS max_x, greatest(y0,y1,y2,y3,y4) AS max_y FROM p")
def polyline_bounds(spark, sf_dir):
    t = views.embedding_polylines(spark, sf_dir).withColumn("b", geom.bounds("pts"))
    return t.select("trace_id", r6(geom.length("pts")).alias("length"), "b.min_x", "b.min_y", "b.max_x", "b.max_y")


_SXX = "+".join(f"(x{k}-mx)*(x{k}-mx)" for k in range(5))
_SXY = "+".join(f"(x{k}-mx)*(y{k}-my)" for k in range(5))


@query(f"""WITH {_POLY}, q AS (SELECT *, (x0+x1+x2+x3+x4)/5.0 AS mx, (y0+y1+y2+y3+y4)/5.0 AS my FROM p),
s AS (SELECT id, ({_SXY})/({_SXX}) AS slope FROM q)
SELECT id AS trace_id, round(CASE WHEN abs(slope) < 1e-8 THEN 0.0 WHEN degrees(atan(1/slope)) < 0 THEN degrees(atan(1/slope))+180.0 ELSE degrees(atan(1/slope)) END, 6) AS regression FROM s""")
def regression_azimuths(spark, sf_dir):
    t = views.embedding_polylines(spark, sf_dir)
    return t.select("trace_id", r6(geom.regression_azimuth("pts")).alias("regression"))


@query(f"WITH {ORDERS_SQL} SELECT grp AS network, min(least(x0,x1)) AS min_x, min(least(y0,y1)) AS min_y, max(greatest(x0,x1)) AS max_x, max(greatest(y0,y1)) AS max_y FROM l GROUP BY 1")
def total_bounds(spark, sf_dir):
    return sampling.total_bounds(views.order_traces(spark, sf_dir))


@query(f"""WITH {ORDERS_SQL}, {_MEASURED}, n AS (SELECT grp, {_SET} AS s, count(*) AS n, sum(len) AS total FROM m GROUP BY 1, 2),
e AS (SELECT grp, s FROM (SELECT DISTINCT grp FROM m), (VALUES ('1'), ('2'), ('3')) v(s)), j AS (SELECT e.grp, e.s, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM e LEFT JOIN n USING (grp, s))
SELECT grp AS network, s AS azimuth_set, n, round(total, 6) AS total, round(total / sum(total) OVER (PARTITION BY grp), 6) AS share, rank() OVER (PARTITION BY grp ORDER BY total DESC)::INTEGER AS rank FROM j""")
def azimuth_set_counts(spark, sf_dir):
    m = _measured(views.order_traces(spark, sf_dir)).withColumn("azimuth_set", geom.set_of(F.col("azimuth"), SETS[1], SETS[0], around=True))
    out = params.set_table(m, "azimuth_set", SETS[0])
    return out.select("network", "azimuth_set", "n", r6("total").alias("total"), r6("share").alias("share"), "rank")


@query(f"""WITH {ORDERS_SQL}, {_MEASURED}, n AS (SELECT grp, CASE WHEN len BETWEEN 0 AND 4 THEN 'short' WHEN len BETWEEN 4 AND 8 THEN 'middle' WHEN len BETWEEN 8 AND 100 THEN 'long' END AS s, count(*) AS n FROM m GROUP BY 1, 2)
SELECT grp AS network, s AS length_set, n FROM n""")
def length_set_counts(spark, sf_dir):
    m = _measured(views.order_traces(spark, sf_dir)).withColumn("length_set", geom.set_of(F.col("length"), LENGTH_SETS[1], LENGTH_SETS[0]))
    return params.set_table(m, "length_set", LENGTH_SETS[0]).select("network", "length_set", "n")


@query(f"""WITH {ORDERS_SQL}, {_MEASURED}, c AS (SELECT grp, ceil(180.0/(180.0/(2*pow(count(*), 1/3::DOUBLE))))::INTEGER AS bins FROM m GROUP BY 1),
h AS (SELECT grp, least(floor(az/(180.0/bins))::INTEGER, bins-1) AS bin, sum(len) AS height FROM m JOIN c USING (grp) GROUP BY 1, 2),
e AS (SELECT grp, bins, unnest(range(bins))::INTEGER AS bin FROM c)
SELECT grp AS network, bin, round((bin+0.5)*180.0/bins, 6) AS centre, round(180.0/bins, 6) AS width, round(coalesce(height, 0), 6) AS height FROM e LEFT JOIN h USING (grp, bin)""")
def rose_bins(spark, sf_dir):
    out = params.rose(_measured(views.order_traces(spark, sf_dir)))
    return out.select("network", "bin", r6("centre").alias("centre"), r6("width").alias("width"), r6("height").alias("height"))


@query(f"""WITH {ORDERS_SQL}, {_MEASURED} SELECT grp AS network, count(*) AS n, round(sum(len)/1048576, 6) AS p21, round(sum(len)/1048576*avg(len), 6) AS p22, round(min(len), 6) AS least, round(max(len), 6) AS greatest, round(avg(len), 6) AS mean FROM m GROUP BY 1""")
def parameters_without_topology(spark, sf_dir):
    t = views.order_traces(spark, sf_dir)
    areas = t.select("network").distinct().select("network", F.lit(1048576.0).alias("area"))
    p = params.topology_parameters(_measured(t), areas)
    names = {"p21": "Fracture Intensity P21", "p22": "Dimensionless Intensity P22", "least": "Trace Min Length", "greatest": "Trace Max Length", "mean": "Trace Mean Length"}
    return p.select("network", F.col("`Number of Traces (Real)`").cast("long").alias("n"), *[r6(F.col(f"`{v}`")).alias(k) for k, v in names.items()])


_CCM = f"""{ORDERS_SQL}, {_MEASURED}, k AS (SELECT grp, len, count(*) AS c FROM m GROUP BY 1, 2),
d AS (SELECT grp, len, sum(c) OVER (PARTITION BY grp ORDER BY len DESC) / sum(c) OVER (PARTITION BY grp) AS ccm FROM k)"""


@query(f"WITH {_CCM} SELECT grp AS network, round(len, 6) AS length, round(ccm, 6) AS ccm FROM d")
def ccm_by_network(spark, sf_dir):
    out = lengths.ccm(_measured(views.order_traces(spark, sf_dir)))
    return out.select("network", r6("length").alias("length"), r6("ccm").alias("ccm"))


@query(f"WITH {_CCM} SELECT grp AS network, round(regr_slope(ln(ccm), ln(len)), 6) AS slope, round(regr_intercept(ln(ccm), ln(len)), 6) AS intercept, round(abs(1-regr_r2(ln(ccm), ln(len))), 6) AS score, count(*) AS n FROM d GROUP BY 1")
def loglog_fit(spark, sf_dir):
    out = lengths.loglog_fit(lengths.ccm(_measured(views.order_traces(spark, sf_dir))), ["network"])
    return out.select("network", r6("slope").alias("slope"), r6("intercept").alias("intercept"), r6("score").alias("score"), "n")


@query(f"WITH {_CCM} SELECT round(regr_slope(ln(ccm/1048576), ln(len)), 6) AS slope, round(regr_intercept(ln(ccm/1048576), ln(len)), 6) AS intercept, count(*) AS n FROM d WHERE len >= 4")
def multi_scale_fit(spark, sf_dir):
    t = _measured(views.order_traces(spark, sf_dir))
    networks = t.select("network").distinct()
    out = lengths.multi_scale_fit(t, networks.select("network", F.lit(1048576.0).alias("area")), networks.select("network", F.lit(4.0).alias("xmin")))
    return out.select(r6("slope").alias("slope"), r6("intercept").alias("intercept"), "n")


@query(f"""WITH {_CCM}, k2 AS (SELECT grp, unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS q, unnest(quantile_cont(len, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])) AS cut FROM d GROUP BY grp)
SELECT q, round(regr_slope(ln(ccm/1048576), ln(len)), 6) AS slope, round(regr_intercept(ln(ccm/1048576), ln(len)), 6) AS intercept, round(abs(1-regr_r2(ln(ccm/1048576), ln(len))), 6) AS score, count(*) AS n FROM d JOIN k2 USING (grp) WHERE len >= cut GROUP BY 1""")
def optimised_cut_offs(spark, sf_dir):
    t = _measured(views.order_traces(spark, sf_dir))
    areas = t.select("network").distinct().select("network", F.lit(1048576.0).alias("area"))
    out = lengths.optimised_cut_offs(t, areas)
    return out.select("q", r6("slope").alias("slope"), r6("intercept").alias("intercept"), r6("score").alias("score"), "n")


@query(f"WITH {ORDERS_SQL}, {_MEASURED} SELECT grp AS network, round(avg(CASE WHEN len < 4 THEN 1 ELSE 0 END), 6) AS share, round(CASE WHEN count(*) > 50 THEN 1.36/sqrt(count(*)) ELSE 'nan'::DOUBLE END, 6) AS critical FROM m GROUP BY 1")
def cut_off_proportion(spark, sf_dir):
    t = _measured(views.order_traces(spark, sf_dir))
    share = lengths.cut_off_share(t, t.select("network").distinct().withColumn("xmin", F.lit(4.0)))
    n = t.groupBy("network").agg(F.count("*").alias("n"))
    return share.join(n, "network").select("network", r6("share").alias("share"), r6(lengths.critical_distance(F.col("n"))).alias("critical"))


@query(f"""WITH {ORDERS_SQL}, {_MEASURED}, f AS (SELECT grp, count(*) AS n, 1+count(*)/sum(ln(len/4.0)) AS alpha FROM m WHERE len >= 4 GROUP BY 1),
k AS (SELECT grp, len, count(*) AS c FROM m WHERE len >= 4 GROUP BY 1, 2), b AS (SELECT grp, len, sum(c) OVER (PARTITION BY grp ORDER BY len) - c AS below FROM k),
d AS (SELECT grp, max(abs(below/n - (1-pow(len/4.0, 1-alpha)))) AS d FROM b JOIN f USING (grp) GROUP BY 1)
SELECT grp AS network, n, round(alpha, 6) AS alpha, round((alpha-1)/sqrt(n), 6) AS sigma, round(1-alpha, 6) AS exponent, round(d, 6) AS d FROM f JOIN d USING (grp)""")
def powerlaw_fixed_xmin(spark, sf_dir):
    out = lengths.powerlaw_fit(_measured(views.order_traces(spark, sf_dir)), xmin=4.0)
    return out.select("network", "n", r6("alpha").alias("alpha"), r6("sigma").alias("sigma"), r6("exponent").alias("exponent"), r6("d").alias("d"))


@query(f"""WITH {EMBEDDINGS_SQL}, {_MEASURED}, k AS (SELECT grp, len, count(*) AS c FROM m GROUP BY 1, 2),
t AS (SELECT grp, len AS xmin, sum(c) OVER w AS n, sum(c*ln(len)) OVER w - (sum(c) OVER w)*ln(len) AS logs FROM k WINDOW w AS (PARTITION BY grp ORDER BY len DESC)),
f AS (SELECT *, 1+n/logs AS alpha FROM t WHERE logs > 0), b AS (SELECT grp, len, sum(c) OVER (PARTITION BY grp ORDER BY len) - c AS below FROM k),
g AS (SELECT f.grp, f.xmin, f.n, f.alpha, max(abs((b.below-a.below)/f.n - (1-pow(b.len/f.xmin, 1-f.alpha)))) AS d
  FROM f JOIN b ON b.grp = f.grp AND b.len >= f.xmin JOIN b a ON a.grp = f.grp AND a.len = f.xmin GROUP BY 1, 2, 3, 4)
SELECT grp AS network, round(min(d), 6) AS d, round(arg_min(xmin, d), 6) AS xmin, round(arg_min(alpha, d), 6) AS alpha FROM g GROUP BY 1""")
def powerlaw_automatic_xmin(spark, sf_dir):
    out = lengths.powerlaw_fit(_measured(views.embedding_traces(spark, sf_dir)))
    return out.select("network", r6("d").alias("d"), r6("xmin").alias("xmin"), r6("alpha").alias("alpha"))


@query(f"WITH {ORDERS_SQL}, {_MEASURED} SELECT grp AS network, count(*) AS n, round(1/(avg(len)-4.0), 6) AS rate, round(count(*)*(ln(1/(avg(len)-4.0))-1), 4) AS loglikelihood FROM m WHERE len >= 4 GROUP BY 1")
def exponential_fit(spark, sf_dir):
    out = lengths.exponential_fit(_measured(views.order_traces(spark, sf_dir)), xmin=4.0)
    return out.select("network", "n", r6("rate").alias("rate"), F.round("loglikelihood", 4).alias("loglikelihood"))


@query()
def fit_descriptions(spark, sf_dir):
    """All distributions above the automatic xmin, compared; the optimiser has no SQL."""
    t = _measured(views.embedding_traces(spark, sf_dir))
    return lengths.describe_fits(t, lengths.powerlaw_fit(t))


@query(f"""WITH {ORDERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY grp, round(x0, 0), round(y0, 0), round(x1, 0), round(y1, 0) ORDER BY id) AS n FROM l) SELECT id AS trace_id, grp AS network FROM r WHERE n = 1""")
def dedupe_traces(spark, sf_dir):
    return topology.distinct_traces(views.order_traces(spark, sf_dir), 1.0).select("trace_id", "network")


_TURN = " OR ".join(
    [f"((x4-x0)*(x{k + 1}-x{k})+(y4-y0)*(y{k + 1}-y{k})) < 0" for k in range(4)] + [f"((x{k + 1}-x{k})*(x{k + 2}-x{k + 1})+(y{k + 1}-y{k})*(y{k + 2}-y{k + 1})) < 0" for k in range(3)]
)


@query(f"WITH {_POLY} SELECT id AS trace_id, ({_TURN}) AS sharp FROM p")
def sharp_turns(spark, sf_dir):
    return views.embedding_polylines(spark, sf_dir).select("trace_id", validate.sharp_turns("pts").alias("sharp"))


def _meet(a: int, b: int) -> str:
    c = lambda p, q, r: f"sign((x{q}-x{p})*(y{r}-y{p})-(y{q}-y{p})*(x{r}-x{p}))"
    return f"({c(a, a + 1, b)}*{c(a, a + 1, b + 1)} <= 0 AND {c(b, b + 1, a)}*{c(b, b + 1, a + 1)} <= 0)"


@query(f"WITH {_POLY} SELECT id AS trace_id, ({' OR '.join(_meet(a, b) for a in range(4) for b in range(a + 2, 4))}) AS cuts FROM p")
def cuts_itself(spark, sf_dir):
    return views.embedding_polylines(spark, sf_dir).select("trace_id", validate.cuts_itself("pts").alias("cuts"))


def _cross(a: str, b: str, p: str, i: int) -> str:
    return f"sign(({a}.x1-{a}.x0)*({p}.y{i}-{a}.y0)-({a}.y1-{a}.y0)*({p}.x{i}-{a}.x0))"


_BOXES = "least(a.x0,a.x1) <= greatest(b.x0,b.x1) AND least(b.x0,b.x1) <= greatest(a.x0,a.x1) AND least(a.y0,a.y1) <= greatest(b.y0,b.y1) AND least(b.y0,b.y1) <= greatest(a.y0,a.y1)"
_DEN = "((a.x1-a.x0)*(b.y1-b.y0)-(a.y1-a.y0)*(b.x1-b.x0))"
_HIT = f"{_BOXES} AND {_cross('a', 'b', 'b', 0)}*{_cross('a', 'b', 'b', 1)} <= 0 AND {_cross('b', 'a', 'a', 0)}*{_cross('b', 'a', 'a', 1)} <= 0 AND {_DEN} <> 0"
_T = f"(((b.x0-a.x0)*(b.y1-b.y0)-(b.y0-a.y0)*(b.x1-b.x0))/{_DEN})"
_CROSSED = f"c AS (SELECT a.grp, a.id AS a_id, b.id AS b_id, a.x0+{_T}*(a.x1-a.x0) AS x, a.y0+{_T}*(a.y1-a.y0) AS y FROM l a JOIN l b ON a.grp = b.grp AND a.id < b.id AND {_HIT})"


@query(f"WITH {ORDERS_SQL}, {_CROSSED} SELECT grp AS network, a_id, b_id, round(x, 4) AS x, round(y, 4) AS y FROM c")
def crossings(spark, sf_dir):
    out = joins.crossings(views.order_traces(spark, sf_dir), CELL)
    return out.select("network", "a_id", "b_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_MET = "m AS (SELECT grp, a_id AS id, b_id AS other, x, y FROM c UNION ALL SELECT grp, b_id, a_id, x, y FROM c)"
_ON = lambda p, s, i: f"({p}.x{i} BETWEEN least({s}.x0,{s}.x1) AND greatest({s}.x0,{s}.x1) AND {p}.y{i} BETWEEN least({s}.y0,{s}.y1) AND greatest({s}.y0,{s}.y1))"
_TOUCH = _HIT.replace(f" AND {_DEN} <> 0", "")
#: Ends of the common part of parallel segments that meet; traces that run on each other for a stretch.
_OVERLAPPED = "o AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT a.grp, a.id AS a_id, b.id AS b_id, {p}.x{i} AS x, {p}.y{i} AS y FROM l a JOIN l b ON a.grp = b.grp AND a.id < b.id AND {_TOUCH} AND {_DEN} = 0 AND {_ON(p, s, i)}" for p, s in ("ab", "ba") for i in (0, 1)) + "))"
_ALONG = "r AS (SELECT DISTINCT unnest([{'id': a_id, 'other': b_id}, {'id': b_id, 'other': a_id}], recursive := true) FROM (SELECT a_id, b_id FROM o GROUP BY 1, 2 HAVING count(*) > 1))"

_POLY_SEG = "l AS (" + " UNION ALL ".join(f"SELECT id, grp, x{k} AS x0, y{k} AS y0, x{k + 1} AS x1, y{k + 1} AS y1 FROM p" for k in range(4)) + ")"


@query(f"WITH {_POLY}, {_POLY_SEG}, {_CROSSED}, n AS (SELECT a_id, b_id, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) >= 3) SELECT DISTINCT unnest([a_id, b_id]) AS id FROM n")
def multiple_crosscuts(spark, sf_dir):
    return joins.multiple_crosscuts(views.embedding_polylines(spark, sf_dir), 0.1)


_ENDS = "e AS (SELECT id, grp, 0 AS k, x0 AS x, y0 AS y FROM l UNION ALL SELECT id, grp, 1, x1, y1 FROM l)"


@query(f"""WITH {ORDERS_SQL}, {_ENDS}, {_CROSSED}, i AS (SELECT a_id AS id, grp, x, y FROM c UNION ALL SELECT b_id, grp, x, y FROM c),
n AS (SELECT DISTINCT id, grp, round(x, 9) AS x, round(y, 9) AS y FROM i UNION SELECT id, grp, x, y FROM e),
j AS (SELECT DISTINCT a.id, b.id AS o, a.x, a.y FROM n a JOIN n b ON a.grp = b.grp AND a.id <> b.id AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) < 0.55)
SELECT DISTINCT unnest([id, o]) AS id FROM j""")
def near_nodes(spark, sf_dir):
    """Traces with an end or intersection near one of another trace."""
    return joins.junctions(views.order_traces(spark, sf_dir), CELL, 0.55, 1, "crossed")


#: Nodes of traces: where others meet them, but not where ends of both coincide; and ends without such a node nearby.
_NODES = f"""{_ENDS}, {_CROSSED}, {_OVERLAPPED}, z AS (SELECT * FROM c UNION ALL SELECT * FROM o), m AS (SELECT grp, a_id AS id, b_id AS other, x, y FROM z UNION ALL SELECT grp, b_id, a_id, x, y FROM z),
own AS (SELECT DISTINCT m.* FROM m JOIN e ON e.id = m.id AND sqrt(pow(m.x-e.x, 2)+pow(m.y-e.y, 2)) < 1e-4), common AS (SELECT p.* FROM own p JOIN own q ON p.id = q.other AND p.other = q.id AND p.x = q.x AND p.y = q.y),
met AS (SELECT DISTINCT id, grp, x, y FROM (SELECT * FROM m EXCEPT SELECT * FROM common)), free AS (SELECT id, grp, x, y FROM e WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.id = e.id AND sqrt(pow(met.x-e.x, 2)+pow(met.y-e.y, 2)) < 1e-3))"""
_JUNCTIONS = lambda nodes, n: f"""k AS (SELECT a.id, a.x, a.y, count(*) AS n, list(b.id) AS others FROM {nodes} a JOIN {nodes} b ON a.grp = b.grp AND a.id <> b.id AND sqrt(pow(a.x-b.x, 2)+pow(a.y-b.y, 2)) < 0.55 GROUP BY 1, 2, 3 HAVING count(*) >= {n})
SELECT DISTINCT unnest(list_append(others, id)) AS id FROM k"""  # noqa: E731


@query(f"WITH {ORDERS_SQL}, {_NODES}, every AS (SELECT * FROM met UNION ALL SELECT * FROM free), {_JUNCTIONS('every', 2)}")
def multi_junctions(spark, sf_dir):
    return joins.multi_junctions(views.order_traces(spark, sf_dir), CELL, 0.5)


@query(f"WITH {ORDERS_SQL}, {_NODES}, {_JUNCTIONS('free', 1)}")
def v_nodes(spark, sf_dir):
    return joins.v_nodes(views.order_traces(spark, sf_dir), CELL, 0.5)


_PSD = """(CASE WHEN (l.x1-l.x0)*(l.x1-l.x0)+(l.y1-l.y0)*(l.y1-l.y0) > 0 THEN sqrt(pow(e.x-(l.x0+{t}*(l.x1-l.x0)), 2)+pow(e.y-(l.y0+{t}*(l.y1-l.y0)), 2)) END)""".format(
    t="least(1.0, greatest(0.0, ((e.x-l.x0)*(l.x1-l.x0)+(e.y-l.y0)*(l.y1-l.y0))/((l.x1-l.x0)*(l.x1-l.x0)+(l.y1-l.y0)*(l.y1-l.y0))))"
)


@query(f"""WITH {ORDERS_SQL}, {_ENDS}, d AS (SELECT e.id, e.k, l.id AS other, {_PSD} AS d FROM e JOIN l ON e.grp = l.grp AND e.id <> l.id
  AND e.x BETWEEN least(l.x0, l.x1)-0.55 AND greatest(l.x0, l.x1)+0.55 AND e.y BETWEEN least(l.y0, l.y1)-0.55 AND greatest(l.y0, l.y1)+0.55)
SELECT id, k AS "end", other, round(d, 6) AS d FROM d WHERE d < 0.55""")
def end_distances(spark, sf_dir):
    return joins.end_distances(views.order_traces(spark, sf_dir), CELL, 0.55).select("id", "end", "other", r6("d").alias("d"))


@query(f"""WITH {ORDERS_SQL}, {_ENDS}, d AS (SELECT e.id, e.k, l.id AS other, {_PSD} AS d FROM e JOIN l ON e.grp = l.grp AND e.id <> l.id
  AND e.x BETWEEN least(l.x0, l.x1)-0.55 AND greatest(l.x0, l.x1)+0.55 AND e.y BETWEEN least(l.y0, l.y1)-0.55 AND greatest(l.y0, l.y1)+0.55),
n AS (SELECT id, k, min(d) AS least FROM d WHERE d < 0.55 GROUP BY 1, 2 HAVING min(d) > 0.5),
{_CROSSED}, {_MET}, u AS (SELECT DISTINCT m.id, m.other FROM m JOIN l USING (id) WHERE NOT (abs(m.x-l.x0) + abs(m.y-l.y0) < 1e-9) AND NOT (abs(m.x-l.x1) + abs(m.y-l.y1) < 1e-9)),
{_OVERLAPPED}, {_ALONG}
SELECT DISTINCT d.id, CASE WHEN r.id IS NOT NULL THEN 'STACKED TRACES' WHEN u.id IS NOT NULL THEN 'OVERLAPPING SNAP' ELSE 'UNDERLAPPING SNAP' END AS error
FROM d JOIN n USING (id, k) LEFT JOIN u ON u.id = d.id AND u.other = d.other LEFT JOIN r ON r.id = d.id AND r.other = d.other WHERE d.d < 0.55""")
def snap_misses(spark, sf_dir):
    return joins.snap_errors(views.order_traces(spark, sf_dir), CELL, 0.5)


_P = lambda p, i, q: f"sqrt(pow({p}.x{i}-({q}.x0+least(1.0,greatest(0.0,(({p}.x{i}-{q}.x0)*({q}.x1-{q}.x0)+({p}.y{i}-{q}.y0)*({q}.y1-{q}.y0))/(({q}.x1-{q}.x0)*({q}.x1-{q}.x0)+({q}.y1-{q}.y0)*({q}.y1-{q}.y0))))*({q}.x1-{q}.x0)),2)+pow({p}.y{i}-({q}.y0+least(1.0,greatest(0.0,(({p}.x{i}-{q}.x0)*({q}.x1-{q}.x0)+({p}.y{i}-{q}.y0)*({q}.y1-{q}.y0))/(({q}.x1-{q}.x0)*({q}.x1-{q}.x0)+({q}.y1-{q}.y0)*({q}.y1-{q}.y0))))*({q}.y1-{q}.y0)),2))"
_NEAR = "least(a.x0,a.x1) <= greatest(b.x0,b.x1)+0.5 AND least(b.x0,b.x1) <= greatest(a.x0,a.x1)+0.5 AND least(a.y0,a.y1) <= greatest(b.y0,b.y1)+0.5 AND least(b.y0,b.y1) <= greatest(a.y0,a.y1)+0.5"


@query(f"""WITH {ORDERS_SQL}, {_MEASURED}, d AS (SELECT a.id, b.id AS o, a.az AS u, b.az AS v, CASE WHEN a.x0=a.x1 OR a.y0=a.y1 THEN 0 ELSE a.az END AS p, CASE WHEN b.x0=b.x1 OR b.y0=b.y1 THEN 0 ELSE b.az END AS q, CASE WHEN {_BOXES} AND {_cross('a', 'b', 'b', 0)}*{_cross('a', 'b', 'b', 1)} <= 0 AND {_cross('b', 'a', 'a', 0)}*{_cross('b', 'a', 'a', 1)} <= 0 THEN 0.0
  ELSE least({_P('a', 0, 'b')}, {_P('a', 1, 'b')}, {_P('b', 0, 'a')}, {_P('b', 1, 'a')}) END AS d FROM m a JOIN m b ON a.grp = b.grp AND a.id < b.id AND {_NEAR}),
f AS (SELECT DISTINCT unnest([id, o]) AS id FROM d WHERE d <= 0.5 AND (least(abs(u-v), 180-abs(u-v)) < 10 OR least(abs(p-q), 180-abs(p-q)) < 10)) SELECT id AS trace_id, id IN (SELECT id FROM f) AS merge FROM l""")
def proximal_traces(spark, sf_dir):
    return joins.proximal(views.order_traces(spark, sf_dir), CELL, 0.5, 10.0).select("trace_id", "merge")


def _box(spark: SparkSession, traces: DataFrame) -> DataFrame:
    """The box as an area of every network."""
    return traces.select("network").distinct().select(F.xxhash64("network").alias("area_id"), "network", geom.box_rings(*BOX).alias("rings"))


_IN = lambda x, y: f"({x} > {BOX[0]} AND {x} < {BOX[2]} AND {y} > {BOX[1]} AND {y} < {BOX[3]})"
_ENTER = f"""greatest(0.0, CASE WHEN x1<>x0 THEN least(({BOX[0]}-x0)/(x1-x0), ({BOX[2]}-x0)/(x1-x0)) ELSE -1e9 END, CASE WHEN y1<>y0 THEN least(({BOX[1]}-y0)/(y1-y0), ({BOX[3]}-y0)/(y1-y0)) ELSE -1e9 END)"""
_LEAVE = f"""least(1.0, CASE WHEN x1<>x0 THEN greatest(({BOX[0]}-x0)/(x1-x0), ({BOX[2]}-x0)/(x1-x0)) ELSE 1e9 END, CASE WHEN y1<>y0 THEN greatest(({BOX[1]}-y0)/(y1-y0), ({BOX[3]}-y0)/(y1-y0)) ELSE 1e9 END)"""


@query(f"""WITH {ORDERS_SQL}, c AS (SELECT *, {_ENTER} AS t0, {_LEAVE} AS t1 FROM l WHERE (x1<>x0 OR (x0 > {BOX[0]} AND x0 < {BOX[2]})) AND (y1<>y0 OR (y0 > {BOX[1]} AND y0 < {BOX[3]})))
SELECT id AS trace_id, round({_LENGTH}*(t1-t0), 6) AS length FROM c WHERE t1 > t0 + 1e-15""")
def clip_to_box(spark, sf_dir):
    t = views.order_traces(spark, sf_dir)
    return overlay.clip(t, _box(spark, t), CELL).select("trace_id", r6(geom.length("pts")).alias("length"))


@query(f"""WITH {ORDERS_SQL} SELECT id AS trace_id, {_IN('x0', 'y0')} AS start_in, {_IN('x1', 'y1')} AS end_in FROM l WHERE {_IN('x0', 'y0')} OR {_IN('x1', 'y1')}""")
def ends_inside(spark, sf_dir):
    t = views.order_traces(spark, sf_dir)
    inside = joins.inside_areas(grid.ends_of(t), _box(spark, t), CELL)
    return inside.groupBy(F.col("id").alias("trace_id")).agg(F.max(F.col("end") == 0).alias("start_in"), F.max(F.col("end") == 1).alias("end_in"))


_MEETS = f"(x1<>x0 OR (x0 >= {BOX[0]} AND x0 <= {BOX[2]})) AND (y1<>y0 OR (y0 >= {BOX[1]} AND y0 <= {BOX[3]})) AND {_LEAVE} >= {_ENTER} AND NOT ({_IN('x0', 'y0')} AND {_IN('x1', 'y1')})"
_EDGE = lambda x, y: f"(NOT {_IN(x, y)} AND {x} BETWEEN {BOX[0]} AND {BOX[2]} AND {y} BETWEEN {BOX[1]} AND {BOX[3]})"


@query(f"""WITH {ORDERS_SQL}, f AS (SELECT id, {_MEETS} AS near, {_EDGE('x0', 'y0')} AND {_EDGE('x1', 'y1')} AS all_edge, {_IN('x0', 'y0')} OR {_IN('x1', 'y1')} AS inside FROM l),
g AS (SELECT id, near::INTEGER + (all_edge OR (NOT inside AND near))::INTEGER AS crossings FROM f)
SELECT id AS trace_id, crossings, CASE crossings WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS weight FROM g""")
def boundary_weights(spark, sf_dir):
    """Of all traces; an end on a side isn't inside."""
    t = views.order_traces(spark, sf_dir)
    return joins.boundary_counts(joins.boundary_flags(t, _box(spark, t), CELL, 0.01))


_SIDES = "b AS (" + " UNION ALL ".join(f"SELECT {x0}::DOUBLE AS x0, {y0}::DOUBLE AS y0, {x1}::DOUBLE AS x1, {y1}::DOUBLE AS y1" for x0, y0, x1, y1 in ((BOX[0], BOX[1], BOX[2], BOX[1]), (BOX[2], BOX[1], BOX[2], BOX[3]), (BOX[2], BOX[3], BOX[0], BOX[3]), (BOX[0], BOX[3], BOX[0], BOX[1]))) + ")"


@query(f"""WITH {ORDERS_SQL}, {_ENDS}, {_SIDES}, i AS (SELECT *, least(x-{BOX[0]}, {BOX[2]}-x, y-{BOX[1]}, {BOX[3]}-y) AS d FROM e WHERE {_IN('x', 'y')}), n AS (SELECT * FROM i WHERE d >= 0.25 AND d < 0.25*1.1*1.5),
k AS (SELECT a.id, a.x0+{_T}*(a.x1-a.x0) AS px, a.y0+{_T}*(a.y1-a.y0) AS py FROM l a JOIN b ON {_HIT})
SELECT DISTINCT id FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = n.id AND sqrt(pow(px-x, 2)+pow(py-y, 2)) < 2*0.25*1.1*1.5)""")
def target_area_underlaps(spark, sf_dir):
    t = views.order_traces(spark, sf_dir)
    return joins.target_area_underlaps(t, _box(spark, t), CELL, 0.25)


#: Where segments meet, an end that lies there exactly; pieces between such points, each once; nodes by the ends of pieces.
_AT = lambda c: " ".join(["CASE", *[f"WHEN {_cross(s, o, p, i)} = 0 THEN {p}.{c}{i}" for p, s, o in (("a", "b", "a"), ("b", "a", "b")) for i in (0, 1)], f"ELSE a.{c}0+{_T}*(a.{c}1-a.{c}0) END"])
_BRANCHED = f"""c AS (SELECT a.grp, a.id AS a_id, b.id AS b_id, {_AT('x')} AS x, {_AT('y')} AS y FROM l a JOIN l b ON a.grp = b.grp AND a.id < b.id AND {_HIT}), {_OVERLAPPED},
z AS (SELECT * FROM c UNION ALL SELECT * FROM o), w AS (SELECT a_id AS id, x, y FROM z UNION SELECT b_id, x, y FROM z UNION SELECT id, x0, y0 FROM l UNION SELECT id, x1, y1 FROM l),
v AS (SELECT l.id, l.grp, w.x, w.y, greatest(0.0, least(1.0, ((w.x-x0)*(x1-x0)+(w.y-y0)*(y1-y0))/((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) AS t FROM w JOIN l USING (id)),
q AS (SELECT id, grp, x, y, lead(x) OVER s AS nx, lead(y) OVER s AS ny, row_number() OVER s - 1 AS piece FROM v WINDOW s AS (PARTITION BY id ORDER BY t, x, y)),
u AS (SELECT *, sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) AS len FROM q WHERE nx IS NOT NULL AND sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) > 1.01e-9),
p AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY grp, least((x, y), (nx, ny)), greatest((x, y), (nx, ny)) ORDER BY id, piece) = 1),
s AS (SELECT id, piece, grp, x, y, len FROM p UNION ALL SELECT id, piece, grp, nx, ny, len FROM p),
n AS (SELECT grp, x, y, CASE WHEN count(*) <= 2 THEN 'I' WHEN count(*) = 3 THEN 'Y' ELSE 'X' END AS class FROM s GROUP BY 1, 2, 3)"""


@query(f"""WITH {ORDERS_SQL}, {_BRANCHED}, k AS (SELECT s.id, piece, count(*) FILTER (WHERE class = 'I') AS i FROM s JOIN n ON s.grp = n.grp AND s.x = n.x AND s.y = n.y GROUP BY 1, 2)
SELECT p.id AS trace_id, p.piece::INTEGER AS piece, grp AS network, round(len, 6) AS length, CASE i WHEN 0 THEN 'C-C' WHEN 1 THEN 'C-I' ELSE 'I-I' END AS connection FROM p JOIN k USING (id, piece)""")
def branches(spark, sf_dir):
    found = topology.classified_in(views.order_traces(spark, sf_dir), CELL, 1e-9)
    return found.select("trace_id", "piece", "network", r6("length").alias("length"), "connection")


@query(f"WITH {ORDERS_SQL}, {_BRANCHED} SELECT grp AS network, count(*) FILTER (WHERE class = 'X') AS \"X\", count(*) FILTER (WHERE class = 'Y') AS \"Y\", count(*) FILTER (WHERE class = 'I') AS \"I\", 0::BIGINT AS \"E\" FROM n GROUP BY 1")
def node_counts(spark, sf_dir):
    return params.node_counts(topology.nodes_in(views.order_traces(spark, sf_dir), CELL, 1e-9))


_XYI = f"{_MEASURED}, {_BRANCHED}, g AS (SELECT grp, count(*) FILTER (WHERE class = 'X') AS nx, count(*) FILTER (WHERE class = 'Y') AS ny, count(*) FILTER (WHERE class = 'I') AS ni FROM n GROUP BY 1)"


@query(f"""WITH {ORDERS_SQL}, {_XYI}, f AS (SELECT grp, count(*) AS n, sum(len) AS total, avg(len) AS mean FROM m GROUP BY 1), h AS (SELECT grp, count(*) AS bn, min(len) AS bmin, max(len) AS bmax FROM p GROUP BY 1),
d AS (SELECT *, (ny+ni)/2.0 AS tn, (4*nx+3*ny+ni)/2.0 AS br, total/1048576 AS p21 FROM g JOIN f USING (grp) JOIN h USING (grp))
SELECT grp AS network, n, bn, round(tn, 6) AS traces, round(br, 6) AS branches, round(bmin, 6) AS branch_min, round(bmax, 6) AS branch_max, round(total/br, 6) AS branch_mean, round(1e6*tn/1048576, 6) AS p20, round(1e6*br/1048576, 6) AS b20,
round(p21*total/br, 6) AS b22, round(2*(ny+nx)/tn, 6) AS per_trace, round((3*ny+4*nx)/br, 6) AS per_branch, round(1e6*(ny+nx)/1048576, 6) AS frequency, 0.0::DOUBLE AS mauldon, round(1e6*(ni+ny)/(2*1048576.0), 6) AS density FROM d""")
def topology_parameters(spark, sf_dir):
    t = _measured(views.order_traces(spark, sf_dir))
    nodes, found = topology.nodes_in(t, CELL, 1e-9), topology.classified_in(t, CELL, 1e-9)
    areas = t.select("network").distinct().select("network", F.lit(1048576.0).alias("area"))
    p = params.topology_parameters(t, areas, nodes, found.select("network", "length"), circular=True)
    of = lambda name, by=1.0: F.round(F.col(f"`{name}`") * by, 6)
    return p.select(
        "network", F.col("`Number of Traces (Real)`").cast("long").alias("n"), F.col("`Number of Branches (Real)`").cast("long").alias("bn"), of("Number of Traces").alias("traces"), of("Number of Branches").alias("branches"),
        of("Branch Min Length").alias("branch_min"), of("Branch Max Length").alias("branch_max"), of("Branch Mean Length").alias("branch_mean"), of("Areal Frequency P20", 1e6).alias("p20"), of("Areal Frequency B20", 1e6).alias("b20"),
        of("Dimensionless Intensity B22").alias("b22"), of("Connections per Trace").alias("per_trace"), of("Connections per Branch").alias("per_branch"), of("Connection Frequency", 1e6).alias("frequency"),
        of("Trace Mean Length (Mauldon)").alias("mauldon"), of("Fracture Density (Mauldon)", 1e6).alias("density"),
    )


_D = "(CASE WHEN abs(az-{a}) <= 90 THEN abs(az-{a}) ELSE 180.0-abs(az-{a}) END)"


@query("WITH " + EMBEDDINGS_SQL + ", " + _MEASURED + " " + " UNION ALL ".join(f"SELECT grp AS network, {a} AS angle, round(sum(len*cos(radians({_D.format(a=a)}))), 6) AS value FROM m GROUP BY 1" for a in params.ANGLES))
def anisotropy(spark, sf_dir):
    b = _measured(views.embedding_traces(spark, sf_dir)).withColumn("connection", F.lit("C-C"))
    return params.anisotropy(b).select("network", "angle", r6("value").alias("value"))


@query(f"WITH {ORDERS_SQL}, {_MEASURED}, c AS (SELECT grp, count(*) FILTER (WHERE len < 4) AS a, count(*) FILTER (WHERE len >= 4 AND len < 8) AS b, count(*) FILTER (WHERE len >= 8) AS c FROM m GROUP BY 1) SELECT grp AS network, round(100.0*a/(a+b+c), 6) AS p1, round(100.0*c/(a+b+c), 6) AS p2, round(100.0*b/(a+b+c), 6) AS p3 FROM c")
def ternary_points(spark, sf_dir):
    m = _measured(views.order_traces(spark, sf_dir))
    c = m.groupBy("network").agg(F.count(F.when(F.col("length") < 4, 1)).alias("a"), F.count(F.when((F.col("length") >= 4) & (F.col("length") < 8), 1)).alias("b"), F.count(F.when(F.col("length") >= 8, 1)).alias("c"))
    return params.ternary(c, ("a", "b", "c")).select("network", *[r6(k).alias(k) for k in ("p1", "p2", "p3")])


_NODE_AT = _PSD.replace("e.", "n.")


@query(f"""WITH {ORDERS_SQL}, {_MEASURED}, {_BRANCHED}, a AS (SELECT id, {_SET} AS k FROM m), near AS (SELECT DISTINCT n.grp, n.x, n.y, n.class, l.id, least(sqrt(pow(n.x-l.x0, 2)+pow(n.y-l.y0, 2)), sqrt(pow(n.x-l.x1, 2)+pow(n.y-l.y1, 2))) <= 0.001 AS at_end
  FROM n JOIN l ON n.grp = l.grp AND n.class IN ('X', 'Y') AND n.x BETWEEN least(l.x0, l.x1)-0.001 AND greatest(l.x0, l.x1)+0.001 AND n.y BETWEEN least(l.y0, l.y1)-0.001 AND greatest(l.y0, l.y1)+0.001 AND {_NODE_AT} <= 0.001),
h AS (SELECT near.grp, x, y, class, k, max(at_end) AS at_end FROM near JOIN a USING (id) WHERE k <> '-1' GROUP BY 1, 2, 3, 4, 5), f AS (SELECT DISTINCT grp, k FROM m JOIN a USING (id) WHERE k <> '-1'),
g AS (SELECT i.grp, i.k AS first, j.k AS second, count(*) FILTER (WHERE i.class = 'X') AS x, count(*) FILTER (WHERE i.class = 'Y' AND i.at_end) AS y, count(*) FILTER (WHERE i.class = 'Y' AND NOT i.at_end) AS r FROM h i JOIN h j ON i.grp = j.grp AND i.x = j.x AND i.y = j.y AND i.k < j.k GROUP BY 1, 2, 3)
SELECT i.grp AS network, i.k AS first, j.k AS second, coalesce(g.x, 0) AS x, coalesce(g.y, 0) AS y, coalesce(r, 0) AS y_reverse, 0::BIGINT AS error_count FROM f i JOIN f j ON i.grp = j.grp AND i.k < j.k LEFT JOIN g ON g.grp = i.grp AND g.first = i.k AND g.second = j.k""")
def azimuth_set_relations(spark, sf_dir):
    t = _measured(views.order_traces(spark, sf_dir)).withColumn("azimuth_set", geom.set_of(F.col("azimuth"), SETS[1], SETS[0], around=True))
    return topology.relations_in(t, CELL, 1e-9, "azimuth_set", SETS[0], 0.001)


_W = 64.0


def _half(sign: str) -> str:
    return f"least(1.0, greatest(0.0, (-b{sign}sqrt(greatest(b*b-4*a*c, 0)))/(2*a)))"


@query(f"""WITH {ORDERS_SQL}, w AS (SELECT grp, min(least(x0,x1)) AS lx, max(greatest(y0,y1)) AS hy, ceil((max(greatest(x0,x1))-min(least(x0,x1)))/{_W})::INTEGER AS cols, ceil((max(greatest(y0,y1))-min(least(y0,y1)))/{_W})::INTEGER AS rws FROM l GROUP BY 1),
k AS (SELECT grp, lx, hy, rws, unnest(range(cols)) AS c, cols FROM w), g AS (SELECT grp, (c*rws+r)::BIGINT AS cell_id, lx+c*{_W}+{_W}/2 AS cx, hy-r*{_W}-{_W}/2 AS cy FROM (SELECT *, unnest(range(rws)) AS r FROM k)),
q AS (SELECT g.grp, cell_id, l.id, (x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) AS a, 2*((x0-cx)*(x1-x0)+(y0-cy)*(y1-y0)) AS b, (x0-cx)*(x0-cx)+(y0-cy)*(y0-cy)-{(1.5 * _W) ** 2} AS c
  FROM g JOIN l ON g.grp = l.grp AND least(x0,x1) <= cx+{1.5 * _W} AND greatest(x0,x1) >= cx-{1.5 * _W} AND least(y0,y1) <= cy+{1.5 * _W} AND greatest(y0,y1) >= cy-{1.5 * _W}),
s AS (SELECT grp, cell_id, CASE WHEN b*b-4*a*c > 0 THEN ({_half('+')}-{_half('-')})*sqrt(a) ELSE 0 END AS len FROM q), u AS (SELECT grp, cell_id, count(*) AS n, sum(len) AS total FROM s WHERE len > 0 GROUP BY 1, 2)
SELECT grp AS network, cell_id, coalesce(n, 0) AS n, round(coalesce(total, 0), 4) AS total FROM g LEFT JOIN u USING (grp, cell_id)""")
def contour_grid(spark, sf_dir):
    out = sampling.contour_grid(views.order_traces(spark, sf_dir), _W)
    return out.select("network", "cell_id", F.col("`Number of Traces (Real)`").cast("long").alias("n"), F.round(F.col("`Fracture Intensity P21`") * (1.5 * _W) ** 2 * 32 * F.sin(F.pi() / 32), 4).alias("total"))


@query(f"WITH {ORDERS_SQL}, {_MEASURED}, s AS (SELECT grp, sum(sin(radians(az))) AS s, sum(cos(radians(az))) AS c FROM m GROUP BY 1), n AS (SELECT grp, CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c))+360 ELSE degrees(atan2(s, c)) END AS mean FROM s) SELECT grp AS network, round(mean, 6) AS mean, round(sqrt(avg(pow(least(abs(az-mean), 360-abs(az-mean)), 2))), 6) AS spread FROM m JOIN n USING (grp) GROUP BY 1, 2")
def circular_means(spark, sf_dir):
    out = params.circular_mean(_measured(views.order_traces(spark, sf_dir)))
    return out.select("network", r6("mean").alias("mean"), r6("spread").alias("spread"))


@query(f"WITH {ORDERS_SQL}, b AS (SELECT grp, min(least(x0,x1)) AS a, min(least(y0,y1)) AS b, max(greatest(x0,x1)) AS c, max(greatest(y0,y1)) AS d FROM l GROUP BY 1) SELECT grp AS network, round(greatest(2*(c-a), 2)*greatest(2*(d-b), 2), 6) AS area FROM b")
def bounding_areas(spark, sf_dir):
    return sampling.bounding_polygons(views.order_traces(spark, sf_dir)).select("network", r6(geom.polygon_area("rings")).alias("area"))


@query(f"""WITH {ORDERS_SQL}, {_MEASURED}, c AS (SELECT grp, id % 100 AS k, count(*) FILTER (WHERE len < 4) AS a, count(*) FILTER (WHERE len >= 4 AND len < 8) AS b, count(*) FILTER (WHERE len >= 8) AS c FROM m GROUP BY 1, 2),
n AS (SELECT grp, least(floor(100.0*a/(a+b+c)/2.5)::INTEGER, 39) AS i, least(floor(100.0*c/(a+b+c)/2.5)::INTEGER, 39) AS j, count(*) AS n FROM c GROUP BY 1, 2, 3),
w AS (SELECT k, exp(-k*k/8.0) AS w FROM (SELECT unnest(range(-8, 9)) AS k)), z AS (SELECT k, w / (SELECT sum(w) FROM w) AS w FROM w),
s AS (SELECT grp, (i+a.k)::INTEGER AS i, (j+b.k)::INTEGER AS j, sum(n*a.w*b.w) AS smooth FROM n, z a, z b WHERE i+a.k BETWEEN 0 AND 39 AND j+b.k BETWEEN 0 AND 39 GROUP BY 1, 2, 3)
SELECT grp AS network, s.i, s.j, coalesce(n.n, 0) AS n, round(smooth, 6) AS smooth FROM s LEFT JOIN n USING (grp, i, j)""")
def ternary_heatmap(spark, sf_dir):
    m = _measured(views.order_traces(spark, sf_dir)).withColumn("k", F.col("trace_id") % 100)
    c = m.groupBy("network", "k").agg(F.count(F.when(F.col("length") < 4, 1)).alias("a"), F.count(F.when((F.col("length") >= 4) & (F.col("length") < 8), 1)).alias("b"), F.count(F.when(F.col("length") >= 8, 1)).alias("c"))
    return params.ternary_heatmap(params.ternary(c, ("a", "b", "c"), ["network", "k"]), by=["network"]).withColumn("smooth", r6("smooth"))


@query()
def random_circles(spark, sf_dir):
    t = views.order_traces(spark, sf_dir)
    areas = t.select("network").distinct().select("network", F.lit(512.0).alias("x"), F.lit(512.0).alias("y"), F.lit(500.0).alias("r"))
    return sampling.subsample(t, areas, 20, 50.0)


@query(f"WITH {ORDERS_SQL}, {_MEASURED}, s AS (SELECT grp, id % 7 AS k, count(*)::DOUBLE AS n, avg(len) AS mean, sum(len) AS area FROM m GROUP BY 1, 2) SELECT grp AS name, round(sum(area), 6) AS area, round(sum(n), 6) AS n, round(sum(mean*area)/sum(area), 6) AS mean FROM s GROUP BY 1")
def weighted_sample_aggregate(spark, sf_dir):
    m = _measured(views.order_traces(spark, sf_dir))
    s = m.groupBy(F.col("network").alias("name"), (F.col("trace_id") % 7).alias("k")).agg(F.count("*").cast("double").alias("Number of Traces"), F.avg("length").alias("Trace Mean Length"), F.sum("length").alias("Area")).drop("k")
    out = params.weighted_samples(s)
    return out.select("name", r6("Area").alias("area"), r6(F.col("`Number of Traces`")).alias("n"), r6(F.col("`Trace Mean Length`")).alias("mean"))


@query()
def snapped_traces(spark, sf_dir):
    t = views.order_traces(spark, sf_dir)
    out = topology.snap_traces(t, CELL, 0.05)
    return out.select("trace_id", "network", F.size("pts").alias("vertices"), r6(geom.length("pts")).alias("length"))


@query()
def merged_lines(spark, sf_dir):
    return overlay.line_merge(views.order_traces(spark, sf_dir), 10.0, 0.25).select("trace_id", "network", F.size("pts").alias("vertices"))


@query()
def validation_errors(spark, sf_dir):
    t = views.order_traces(spark, sf_dir)
    return validate.validated(t, _box(spark, t), CELL, validate.Thresholds(snap=0.1)).select("trace_id", "network", "errors")
