"""Registered queries over the driver's tables, with the SQL that checks them.

Curves are the users of ``events`` (irregular, planar: value and props.k), the vectors of
``embeddings`` (one dimension on a common grid, the label as participant).  Floats are rounded to six
places in both engines, and every query runs over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import basis as bas
from ..operators import decomposition as dec
from ..operators import distances as dist
from ..operators import elastic
from ..operators import function_on_scalar as fos
from ..operators import functional_mixed as fm
from ..operators import generalized as gen
from ..operators import geometry as geo
from ..operators import inference as inf
from ..operators import information as info
from ..operators import observation as obs
from ..operators import neighbours as nbr
from ..operators import recurrence as rec
from ..operators import outliers as outl
from ..operators import score_regression as sr
from ..operators import sparse
from ..operators import sparse_fit as sf
from ..operators import stability as stab
from ..operators import tiles
from ..operators import wild
from ..sources.curves import embeddings, events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "rqa_metrics"

_EV = """ev AS (SELECT user_id AS curve_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t_idx,
 (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS t, value AS x,
 CAST(regexp_extract(props, '"k": ?([0-9.]+)', 1) AS DOUBLE) AS y,
 list_position(['click','error','purchase','signup','view'], event_type) - 1 AS state,
 CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS observed FROM events)"""
_EM = """em AS (SELECT vec_id AS curve_id, label AS participant, i - 1 AS t_idx, (i - 1) / 63.0::DOUBLE AS t, embedding[i]::DOUBLE AS x
 FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""


def _round(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, exact: bool = False):
    """Registers a query by its name; ``sql`` is its oracle.  ``exact``: plain arithmetic that both engines do alike isn't rounded."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f if exact else lambda spark, sf_dir: _round(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_EV}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY curve_id ORDER BY t_idx) AS dt FROM ev)
SELECT curve_id, count(*) AS n_samples, round(min(t),6) AS start, round(max(t),6) AS "end", round(quantile_cont(dt,0.5),6) AS median_interval,
 round(max(dt),6) AS max_interval, round(avg(((x IS NULL)::INT + (y IS NULL)::INT)/2.0),6) AS missing_fraction FROM d GROUP BY curve_id""")
def sampling_summary(spark, d):
    return geo.sampling_summary(events(spark, d))


@query(f"""WITH {_EV}, p AS (SELECT curve_id, min(t) a, max(t) b FROM ev GROUP BY curve_id)
SELECT round(max(a),6) AS start, round(min(b),6) AS "end", min(b) > max(a) AS valid FROM p""")
def overlap_interval(spark, d):
    return geo.common_overlap_interval(events(spark, d))


_GRID = """p AS (SELECT curve_id, min(t) a, max(t) b FROM ev GROUP BY curve_id), iv AS (SELECT max(a) lo, min(b) hi FROM p),
grid AS (SELECT i AS g_idx, lo + i * (hi - lo) / 20 AS g FROM iv, (SELECT unnest(range(0, 21)) AS i))"""


@query(f"WITH {_EV}, {_GRID} SELECT g_idx, round(g,6) AS g FROM grid")
def common_grid(spark, d):
    return geo.make_common_grid(geo.common_overlap_interval(events(spark, d)), 21)


@query(f"""WITH {_EV}, {_GRID}, s AS (SELECT *, lead(t) OVER w AS t2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM ev WINDOW w AS (PARTITION BY curve_id ORDER BY t_idx))
SELECT curve_id, g_idx, round(g,6) AS t, round(CASE WHEN g = t THEN x WHEN t2 - t <= 1000 THEN x + (x2 - x) * (g - t)/(t2 - t) END,6) AS x,
 round(CASE WHEN g = t THEN y WHEN t2 - t <= 1000 THEN y + (y2 - y) * (g - t)/(t2 - t) END,6) AS y
FROM s JOIN grid ON g >= t AND (g < t2 OR (t2 IS NULL AND g = t))""")
def resample_linear(spark, d):
    e = events(spark, d)
    return geo.resample_linear(e, geo.make_common_grid(geo.common_overlap_interval(e), 21), max_gap=1000.0)


@query(f"""WITH {_EV}, m AS (SELECT curve_id, t_idx, t, CASE WHEN observed = 1 THEN x END AS x FROM ev),
b AS (SELECT m.*, max(CASE WHEN x IS NOT NULL THEN t END) OVER (PARTITION BY curve_id ORDER BY t_idx) AS tb, min(CASE WHEN x IS NOT NULL THEN t END) OVER (PARTITION BY curve_id ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ta FROM m)
SELECT b.curve_id, b.t_idx, round(CASE WHEN b.x IS NOT NULL THEN b.x WHEN ta - tb <= 24 THEN p.x + (q.x - p.x) * (b.t - tb)/(ta - tb) END,6) AS x, b.x IS NULL AND coalesce(ta - tb <= 24, false) AS filled
FROM b LEFT JOIN m p ON p.curve_id = b.curve_id AND p.t = tb LEFT JOIN m q ON q.curve_id = b.curve_id AND q.t = ta""")
def gap_fill_linear(spark, d):
    m = events(spark, d).withColumn("x", F.when(F.col("observed") == 1, F.col("x")))
    return geo.interpolate_short_gaps(m, "x", 24.0).select("curve_id", "t_idx", "x", "filled")


@query(f"""WITH {_EV} SELECT curve_id, t_idx, round((t - min(t) OVER w)/(max(t) OVER w - min(t) OVER w),6) AS t FROM ev WINDOW w AS (PARTITION BY curve_id)""")
def time_normalize(spark, d):
    return geo.normalize_time(events(spark, d)).select("curve_id", "t_idx", "t")


def _gradient_sql(v: str, t: str = "t") -> str:
    g = {k: f"{f}({c},{n}) OVER w" for c, q in ((v, "v"), (t, "s")) for k, f, n in ((f"{q}m1", "lag", 1), (f"{q}m2", "lag", 2), (f"{q}p1", "lead", 1), (f"{q}p2", "lead", 2))}
    hb, hf = f"({t}-{g['sm1']})", f"({g['sp1']}-{t})"
    a, b = f"({g['sp1']}-{t})", f"({g['sp2']}-{g['sp1']})"
    c, e = f"({g['sm1']}-{g['sm2']})", f"({t}-{g['sm1']})"
    return f"""CASE WHEN {g['sm1']} IS NULL THEN -(2*{a}+{b})/({a}*({a}+{b}))*{v} + ({a}+{b})/({a}*{b})*{g['vp1']} - {a}/({b}*({a}+{b}))*{g['vp2']}
 WHEN {g['sp1']} IS NULL THEN {e}/({c}*({c}+{e}))*{g['vm2']} - ({c}+{e})/({c}*{e})*{g['vm1']} + (2*{e}+{c})/({e}*({c}+{e}))*{v}
 ELSE ({hb}*{hb}*{g['vp1']} + ({hf}*{hf}-{hb}*{hb})*{v} - {hf}*{hf}*{g['vm1']})/({hb}*{hf}*({hb}+{hf})) END"""


_W = "WINDOW w AS (PARTITION BY curve_id ORDER BY t_idx)"
_KIN = f"""{_EV}, k1 AS (SELECT *, {_gradient_sql('x')} AS vx, {_gradient_sql('y')} AS vy FROM ev {_W}),
k2 AS (SELECT *, {_gradient_sql('vx')} AS ax, {_gradient_sql('vy')} AS ay, sqrt(vx*vx+vy*vy) AS speed FROM k1 {_W})"""


@query(f"WITH {_KIN} SELECT curve_id, t_idx, round(vx,6) AS vx, round(vy,6) AS vy FROM k2")
def gradient_velocity(spark, d):
    return geo.kinematics(events(spark, d)).select("curve_id", "t_idx", "vx", "vy")


@query(f"WITH {_KIN} SELECT curve_id, t_idx, round(speed,6) AS speed, round(sqrt(ax*ax+ay*ay),6) AS acceleration FROM k2")
def speed_acceleration(spark, d):
    return geo.kinematics(events(spark, d)).select("curve_id", "t_idx", "speed", "acceleration")


@query(f"WITH {_KIN} SELECT curve_id, t_idx, round(CASE WHEN speed > 0.5 THEN atan2(vy,vx) END,6) AS heading, round(CASE WHEN speed > 0.5 THEN (vx*ay-vy*ax)/pow(speed,3) END,6) AS curvature, round(CASE WHEN speed > 0.5 THEN (vx*ay-vy*ax)/(speed*speed) END,6) AS turning_rate FROM k2")
def heading_curvature_turning(spark, d):
    return geo.kinematics(events(spark, d), min_speed=0.5).select("curve_id", "t_idx", "heading", "curvature", "turning_rate")


@query(f"""WITH {_EV}, s AS (SELECT *, coalesce(sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)),0) AS st FROM ev {_W})
SELECT curve_id, t_idx, round(sum(st) OVER (PARTITION BY curve_id ORDER BY t_idx),6) AS path FROM s""")
def path_length(spark, d):
    return geo.kinematics(events(spark, d)).select("curve_id", "t_idx", "path")


@query(f"""WITH {_EV}, s AS (SELECT *, sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)) AS st FROM ev {_W}),
p AS (SELECT curve_id, sum(st) l, sqrt(pow(arg_max(x,t_idx)-arg_min(x,t_idx),2)+pow(arg_max(y,t_idx)-arg_min(y,t_idx),2)) AS dd FROM s GROUP BY curve_id)
SELECT curve_id, round(l,6) AS path_length, round(dd,6) AS displacement, round(CASE WHEN dd > 1 THEN l/dd END,6) AS tortuosity FROM p""")
def tortuosity(spark, d):
    return geo.tortuosity(events(spark, d), 1.0)


@query(f"WITH {_EV} SELECT curve_id, t_idx, round(sqrt(pow(x-50,2)+pow(y-50,2)),6) AS distance FROM ev")
def landmark_distance(spark, d):
    return geo.distance_to_landmark(events(spark, d), 50.0, 50.0).select("curve_id", "t_idx", "distance")


@query(f"WITH {_EV} SELECT curve_id, t_idx, (x-10.0::DOUBLE)/1024.0::DOUBLE AS x, (y-20.0::DOUBLE)/768.0::DOUBLE AS y FROM ev", exact=True)
def coordinates_centered_normalized(spark, d):
    return geo.normalize_coordinates(geo.center_on_landmark(events(spark, d), 10.0, 20.0), 1024.0, 768.0).select("curve_id", "t_idx", "x", "y")


_SHARES = """sh AS (SELECT user_id AS curve_id, count(*) FILTER (event_type='click')/count(*)::DOUBLE AS a, count(*) FILTER (event_type='view')/count(*)::DOUBLE AS b,
 count(*) FILTER (event_type NOT IN ('click','view'))/count(*)::DOUBLE AS c FROM events GROUP BY 1)"""


def _shares(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.count(F.lit(1))
    share = lambda c: F.count(F.when(c, 1)) / n
    return e.groupBy(F.col("user_id").alias("curve_id")).agg(share(F.col("event_type") == "click").alias("a"), share(F.col("event_type") == "view").alias("b"), share(~F.col("event_type").isin("click", "view")).alias("c"))


@query(f"WITH {_SHARES}, f AS (SELECT curve_id, greatest(a,1e-8) a, greatest(b,1e-8) b, greatest(c,1e-8) c FROM sh) SELECT curve_id, round(ln(a/c),6) AS alr_a, round(ln(b/c),6) AS alr_b FROM f")
def alr(spark, d):
    return geo.alr(_shares(spark, d), ("a", "b", "c"), "c").select("curve_id", "alr_a", "alr_b")


@query(f"WITH {_SHARES}, f AS (SELECT curve_id, greatest(a,1e-8) a, greatest(b,1e-8) b, greatest(c,1e-8) c FROM sh) SELECT curve_id, round(a/(a+b+c),6) AS a, round(b/(a+b+c),6) AS b, round(c/(a+b+c),6) AS c FROM f")
def inverse_alr(spark, d):
    return geo.inverse_alr(geo.alr(_shares(spark, d), ("a", "b", "c"), "c"), ("a", "b", "c"), "c").select("curve_id", "a", "b", "c")


def _warps(spark, d):
    e = geo.normalize_time(events(spark, d))
    first = e.groupBy("curve_id").agg(F.min(F.when(F.col("state") == 2, F.col("t"))).alias("m")).where("m > 0 and m < 1")
    o = first.select("curve_id", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("at")) for k, v in enumerate((F.lit(0.0), F.col("m"), F.lit(1.0)))))).alias("z")).select("curve_id", "z.k", "z.at")
    ref = o.groupBy("k").agg(F.percentile("at", 0.5).alias("at"))
    grid = spark.range(21).select((F.col("id") / 20).alias("t"))
    return geo.landmark_warp(grid, o, ref)


_WARP = f"""{_EV}, nt AS (SELECT *, (t - min(t) OVER w)/(max(t) OVER w - min(t) OVER w) AS u FROM ev WINDOW w AS (PARTITION BY curve_id)),
lm AS (SELECT * FROM (SELECT curve_id, min(u) FILTER (state = 2) AS m FROM nt GROUP BY curve_id) WHERE m > 0 AND m < 1), r AS (SELECT quantile_cont(m,0.5) AS r FROM lm),
wp AS (SELECT curve_id, g/20.0::DOUBLE AS t, CASE WHEN g/20.0::DOUBLE < r THEN m*(g/20.0::DOUBLE)/r ELSE m + (1-m)*(g/20.0::DOUBLE - r)/(1-r) END AS warped FROM lm, r, (SELECT unnest(range(0,21)) AS g))"""


@query(f"WITH {_WARP} SELECT curve_id, round(t,6) AS t, round(warped,6) AS warped FROM wp")
def landmark_warp(spark, d):
    return _warps(spark, d)


@query(f"WITH {_WARP} SELECT curve_id, round(avg(abs(warped-t)),6) AS mean_abs_displacement, round(max(abs(warped-t)),6) AS max_abs_displacement, round(avg(warped-t),6) AS mean_displacement FROM wp GROUP BY curve_id")
def phase_summary(spark, d):
    return geo.phase_summary(_warps(spark, d))


_TW = "(CASE WHEN t_idx IN (0,63) THEN 0.5 ELSE 1 END)/63.0"


@query(f"WITH {_EM} SELECT curve_id, round(sum(x*{_TW}),6) AS integral FROM em GROUP BY curve_id")
def trapezoid_integral(spark, d):
    from ..functions.analytic import along, trapezoid_weight

    e = embeddings(spark, d).withColumn("w", trapezoid_weight(F.col("t"), along("curve_id")))
    return e.groupBy("curve_id").agg(F.sum(F.col("x") * F.col("w")).alias("integral"))


@query(f"WITH {_EM} SELECT t_idx, round(avg(x),6) AS mean, round(stddev_samp(x)/sqrt(count(x)),6) AS se FROM em GROUP BY t_idx")
def functional_mean_se(spark, d):
    return inf.mean_function(embeddings(spark, d))


@query(f"""WITH {_EM} SELECT a.t_idx AS i, b.t_idx AS j, round(covar_samp(a.x, b.x),6) AS cov FROM em a JOIN em b ON a.curve_id = b.curve_id AND a.t_idx <= b.t_idx GROUP BY 1, 2""")
def covariance_surface(spark, d):
    n, s, g = dec.moments(dist.curve_arrays(embeddings(spark, d)))
    cov = (g - np.outer(s, s) / n) / (n - 1)
    return spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(len(s)) for j in range(i, len(s))], "i int, j int, cov double")


@query(f"""WITH {_EM}, p AS (SELECT participant, t_idx, avg(x) AS pm FROM em GROUP BY 1,2), g AS (SELECT t_idx, avg(x) AS gm FROM em GROUP BY 1)
SELECT curve_id, em.t_idx, round(pm-gm,6) AS between, round(x-pm,6) AS within FROM em JOIN p USING (participant, t_idx) JOIN g USING (t_idx)""")
def participant_decomposition(spark, d):
    return dec.multilevel_parts(embeddings(spark, d)).select("curve_id", "t_idx", "between", "within")


def _query_arrays(spark, d):
    """The stated query set (every curve whose id is divisible by 50), and all curves."""
    a = dist.curve_arrays(embeddings(spark, d))
    return a.where("curve_id % 50 = 0"), a


_W64 = dec.trapezoid_weights(np.linspace(0, 1, 64)).tolist()


_L2 = f"""{_EM}, l2 AS (SELECT a.curve_id AS a, b.curve_id AS b, sqrt(sum((a.x-b.x)*(a.x-b.x)*(CASE WHEN a.t_idx IN (0,63) THEN 0.5 ELSE 1 END)/63.0)) AS distance
 FROM em a JOIN em b ON a.t_idx = b.t_idx AND a.curve_id <> b.curve_id WHERE a.curve_id % 50 = 0 GROUP BY 1, 2)"""


@query(f"WITH {_L2} SELECT a, b, round(distance,6) AS distance FROM l2")
def pairwise_l2(spark, d):
    return tiles.l2_distances(*_query_arrays(spark, d), _W64)


@query(f"WITH {_L2} SELECT * EXCLUDE (rank, distance), round(distance,6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM l2) WHERE rank <= 5")
def nearest_curves(spark, d):
    return tiles.nearest_curves(*_query_arrays(spark, d), _W64, 5)


@query(f"""WITH {_EM}, f AS (SELECT t_idx, count(*) n, regr_slope(x, participant) b, regr_intercept(x, participant) a, avg(participant) m, regr_sxx(x, participant) sxx FROM em GROUP BY 1)
SELECT t_idx, n, round(any_value(a),6) AS intercept, round(any_value(b),6) AS slope, round(sqrt(n/(n-2.0)*sum(pow((participant-m)*(x-a-b*participant),2))/pow(any_value(sxx),2)),6) AS slope_se FROM em JOIN f USING (t_idx) GROUP BY t_idx, n""")
def fosr_ols(spark, d):
    return inf.function_on_scalar(embeddings(spark, d), "participant")


@query(f"""WITH {_EV}, s AS (SELECT curve_id, t_idx, x AS s0, lag(x,2) OVER w AS s1, lag(x,4) OVER w AS s2 FROM ev {_W}) SELECT curve_id, t_idx, round(s0,6) AS s0, round(s1,6) AS s1, round(s2,6) AS s2 FROM s WHERE t_idx >= 4""")
def delay_embedding(spark, d):
    e = rec.delay_embed(events(spark, d), ("x",), 3, 2)
    return e.select("curve_id", "t_idx", *(F.col("state")[k].alias(f"s{k}") for k in range(3)))


@query(f"""WITH {_EV}, c AS (SELECT curve_id, t_idx, x - avg(x) OVER (PARTITION BY curve_id) AS c FROM ev), l AS (SELECT unnest(range(0,6)) AS lag)
SELECT a.curve_id, lag, round(sum(a.c*b.c)/any_value(v.v),6) AS acf FROM c a JOIN l ON true JOIN c b ON a.curve_id = b.curve_id AND b.t_idx = a.t_idx + lag JOIN (SELECT curve_id, sum(c*c) v FROM c GROUP BY 1) v ON v.curve_id = a.curve_id GROUP BY 1, 2""")
def acf(spark, d):
    return rec.autocorrelation(events(spark, d), "x", 5)


@query(f"""WITH {_EV}, b AS (SELECT curve_id, t_idx, least(floor((x-min(x) OVER c)/(max(x) OVER c - min(x) OVER c)*8),7) AS b FROM ev WINDOW c AS (PARTITION BY curve_id)),
p AS (SELECT curve_id, b, lead(b,1) OVER (PARTITION BY curve_id ORDER BY t_idx) AS b2 FROM b), j AS (SELECT curve_id, b, b2, count(*) c FROM p WHERE b2 IS NOT NULL GROUP BY 1,2,3)
SELECT curve_id, round(sum(c/n*ln(c*n/(cx*cy))),6) AS ami FROM (SELECT *, sum(c) OVER (PARTITION BY curve_id,b)::DOUBLE cx, sum(c) OVER (PARTITION BY curve_id,b2)::DOUBLE cy, sum(c) OVER (PARTITION BY curve_id)::DOUBLE n FROM j) GROUP BY curve_id""")
def ami(spark, d):
    return rec.mutual_information(events(spark, d), "x", 1)


_REC = f"{_EV}, pr AS (SELECT a.curve_id, a.t_idx AS i, b.t_idx AS j FROM ev a JOIN ev b ON a.curve_id = b.curve_id AND b.t_idx - a.t_idx > 1 WHERE abs(a.x-b.x) <= 5)"


def _rec(spark, d):
    e = events(spark, d)
    return e, rec.recurrence_pairs(e, ("x",), 5.0, 1)


@query(f"WITH {_REC} SELECT * FROM pr")
def recurrence_pairs(spark, d):
    return _rec(spark, d)[1]


@query(f"""WITH {_EV}, p AS (SELECT a.curve_id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS dd FROM ev a JOIN ev b ON a.curve_id = b.curve_id AND b.t_idx - a.t_idx > 1), r AS (SELECT unnest([2.0,10.0,40.0])::DOUBLE AS radius)
SELECT curve_id, radius, count(*) FILTER (dd <= radius) AS n_pairs, round(count(*) FILTER (dd <= radius)/count(*)::DOUBLE,6) AS rate FROM p, r GROUP BY 1, 2""")
def radius_profile(spark, d):
    return rec.radius_profile(events(spark, d), ("x", "y"), [2.0, 10.0, 40.0], 1)


def _rqa_sql(pairs: str, base: str, key: str) -> str:
    return f"""dg AS (SELECT {key}, j-i AS f, i - row_number() OVER (PARTITION BY {key}, j-i ORDER BY i) AS isl FROM {pairs}), dl AS (SELECT {key}, count(*) AS l FROM dg GROUP BY {key}, f, isl),
fu AS (SELECT {key}, i, j FROM {pairs} UNION ALL SELECT {key}, j, i FROM {pairs}), vg AS (SELECT {key}, j, i - row_number() OVER (PARTITION BY {key}, j ORDER BY i) AS isl FROM fu), vl AS (SELECT {key}, count(*) AS l FROM vg GROUP BY {key}, j, isl),
d AS (SELECT {key}, sum(CASE WHEN l>=2 THEN l ELSE 0 END)/sum(l)::DOUBLE AS determinism, avg(l) FILTER (l>=2) AS mean_diagonal, max(l) FILTER (l>=2) AS max_diagonal FROM dl GROUP BY {key}),
en AS (SELECT {key}, -sum(p*ln(p)) AS diagonal_entropy FROM (SELECT {key}, l, count(*)/(sum(count(*)) OVER (PARTITION BY {key}))::DOUBLE AS p FROM dl WHERE l>=2 GROUP BY {key}, l) GROUP BY {key}),
v AS (SELECT {key}, sum(CASE WHEN l>=2 THEN l ELSE 0 END)/sum(l)::DOUBLE AS laminarity, avg(l) FILTER (l>=2) AS trapping_time, max(l) FILTER (l>=2) AS max_vertical FROM vl GROUP BY {key}),
nn AS (SELECT {key}, count(*) AS n FROM {base} GROUP BY {key}), np AS (SELECT {key}, count(*) AS n_pairs, sum(j-i) AS ls FROM {pairs} GROUP BY {key}),
rq AS (SELECT {key}, n, coalesce(n_pairs,0) AS n_pairs, round(2*coalesce(n_pairs,0)/(n*n)::DOUBLE,6) AS recurrence_rate, round(determinism,6) AS determinism, round(mean_diagonal,6) AS mean_diagonal, max_diagonal, round(diagonal_entropy,6) AS diagonal_entropy,
 round(laminarity,6) AS laminarity, round(trapping_time,6) AS trapping_time, max_vertical, round(100*ls/((n-1)*n_pairs)::DOUBLE,6) AS corm FROM nn LEFT JOIN np USING ({key}) LEFT JOIN d USING ({key}) LEFT JOIN en USING ({key}) LEFT JOIN v USING ({key}))"""


@query(f"WITH {_REC}, {_rqa_sql('pr', 'ev', 'curve_id')} SELECT * FROM rq")
def rqa_metrics(spark, d):
    e, p = _rec(spark, d)
    return rec.rqa_metrics(e, p)


@query(f"""WITH {_EV}, nn0 AS (SELECT curve_id, count(*) n FROM ev GROUP BY 1), ws AS (SELECT curve_id, unnest(range(0, n-30+1, 15)) AS window_start FROM nn0), wd AS (SELECT ws.window_start, ev.* FROM ws JOIN ev ON ev.curve_id = ws.curve_id AND t_idx >= window_start AND t_idx < window_start + 30),
pr AS (SELECT a.curve_id, a.window_start, a.t_idx AS i, b.t_idx AS j FROM wd a JOIN wd b ON a.curve_id = b.curve_id AND a.window_start = b.window_start AND b.t_idx > a.t_idx WHERE abs(a.x-b.x) <= 5), ce AS (SELECT curve_id, window_start, (min(t)+max(t))/2 AS centre FROM wd GROUP BY 1,2), {_rqa_sql('pr', 'wd', 'curve_id, window_start')}
SELECT rq.*, round(centre,6) AS centre FROM rq JOIN ce USING (curve_id, window_start)""")
def windowed_rqa(spark, d):
    return rec.windowed_rqa(events(spark, d), ("x",), 5.0, 30, 15)


@query(f"""WITH {_REC}, p2 AS (SELECT a.curve_id, a.t_idx AS i, b.t_idx AS j FROM ev a JOIN ev b ON a.curve_id = b.curve_id AND b.t_idx - a.t_idx > 1 WHERE abs(a.y-b.y) <= 10), jp AS (SELECT * FROM pr INTERSECT SELECT * FROM p2), {_rqa_sql('jp', 'ev', 'curve_id')} SELECT * FROM rq""")
def joint_rqa_metrics(spark, d):
    e, p = _rec(spark, d)
    return rec.rqa_metrics(e, rec.joint_pairs(p, rec.recurrence_pairs(e, ("y",), 10.0, 1)))


_NET = f"""{_REC}, bo AS (SELECT curve_id, i AS t_idx FROM pr UNION ALL SELECT curve_id, j FROM pr), dg0 AS (SELECT curve_id, t_idx, count(*) AS degree FROM bo GROUP BY 1,2),
tr AS (SELECT a.curve_id, a.i, a.j AS k, b.j FROM pr a JOIN pr b ON a.curve_id = b.curve_id AND a.j = b.i JOIN pr c ON c.curve_id = a.curve_id AND c.i = a.i AND c.j = b.j),
tn AS (SELECT curve_id, t_idx, count(*) AS triangles FROM (SELECT curve_id, i AS t_idx FROM tr UNION ALL SELECT curve_id, k FROM tr UNION ALL SELECT curve_id, j FROM tr) GROUP BY 1,2),
nd AS (SELECT curve_id, t_idx, coalesce(degree,0) AS degree, coalesce(triangles,0) AS triangles FROM ev LEFT JOIN dg0 USING (curve_id, t_idx) LEFT JOIN tn USING (curve_id, t_idx)),
nc AS (SELECT *, CASE WHEN degree > 1 THEN 2*triangles/(degree*(degree-1))::DOUBLE ELSE 0 END AS clustering FROM nd)"""


@query(f"WITH {_NET} SELECT curve_id, t_idx, degree, triangles, round(clustering,6) AS clustering FROM nc")
def recurrence_network_nodes(spark, d):
    return rec.network_nodes(*_rec(spark, d))


@query(f"WITH {_NET} SELECT curve_id, count(*) AS n_nodes, round(sum(degree)/2.0::DOUBLE,6) AS n_edges, round(avg(degree),6) AS mean_degree, round(avg(clustering),6) AS mean_clustering, round(sum(triangles)/3.0::DOUBLE,6) AS n_triangles, round(CASE WHEN sum(degree*(degree-1)) > 0 THEN sum(triangles)/(sum(degree*(degree-1))/2.0::DOUBLE) END,6) AS transitivity FROM nc GROUP BY curve_id")
def recurrence_network_summary(spark, d):
    return rec.network_summary(rec.network_nodes(*_rec(spark, d)))


_NN = f"""{_EV}, stt AS (SELECT curve_id, x, y, min(t_idx) AS f, max(t_idx) AS l FROM ev GROUP BY 1, 2, 3),
cand AS (SELECT a.curve_id, a.t_idx AS i, CASE WHEN b.f < a.t_idx - 2 THEN b.f ELSE b.l END AS j, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS dd FROM ev a JOIN stt b ON a.curve_id = b.curve_id AND (b.f < a.t_idx - 2 OR b.l > a.t_idx + 2)),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY curve_id, i ORDER BY dd, j) AS r FROM cand WHERE dd > 0) WHERE r = 1),
dv AS (SELECT n.curve_id, k, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS dd FROM nb n, (SELECT unnest(range(0,6)) AS k) h JOIN ev a ON a.curve_id = n.curve_id AND a.t_idx = n.i + k JOIN ev b ON b.curve_id = n.curve_id AND b.t_idx = n.j + k),
dc AS (SELECT curve_id, k, avg(CASE WHEN dd > 0 THEN ln(dd) END) AS mean_log, count(*) FILTER (dd > 0) AS n, count(*) FILTER (dd = 0) AS zeros FROM dv GROUP BY 1,2)"""


@query(f"WITH {_NN} SELECT curve_id, k, round(mean_log,6) AS mean_log, n, zeros FROM dc")
def nn_divergence(spark, d):
    return nbr.divergence_curve(events(spark, d), ("x", "y"), 2, 5)


@query(f"WITH {_NN} SELECT curve_id, round(regr_slope(mean_log,k),6) AS slope, round(regr_intercept(mean_log,k),6) AS intercept, round(regr_r2(mean_log,k),6) AS r2, count(*) AS n_points FROM dc WHERE k BETWEEN 0 AND 4 GROUP BY curve_id HAVING count(*) >= 3")
def lyapunov_slope(spark, d):
    return rec.lyapunov_slope(nbr.divergence_curve(events(spark, d), ("x", "y"), 2, 5), 0, 4)


@query(f"WITH {_NN} SELECT curve_id, i, j, round(dd,6) AS d FROM nb")
def nearest_neighbours(spark, d):
    return nbr.nearest_neighbours(events(spark, d), ("x", "y"), 2)


_FNN = """g{m} AS (SELECT curve_id, t_idx, {cols} FROM ev WINDOW w AS (PARTITION BY curve_id ORDER BY t_idx)), h{m} AS (SELECT * FROM g{m} WHERE e{m} IS NOT NULL),
s{m} AS (SELECT curve_id, {dims}, min(t_idx) AS f, max(t_idx) AS l FROM h{m} GROUP BY ALL),
c{m} AS (SELECT * FROM (SELECT a.curve_id, a.t_idx AS i, a.e{m} AS p, CASE WHEN b.f < a.t_idx - 2 THEN b.f ELSE b.l END AS j, sqrt({dist}) AS dd FROM h{m} a JOIN s{m} b ON a.curve_id = b.curve_id AND (b.f < a.t_idx - 2 OR b.l > a.t_idx + 2)) WHERE dd > 0 QUALIFY row_number() OVER (PARTITION BY curve_id, i ORDER BY dd, j) = 1),
r{m} AS (SELECT c.curve_id, {m} AS dimension, avg((abs(c.p - b.e{m}) / dd > 10 OR sqrt(dd*dd + (c.p - b.e{m})*(c.p - b.e{m})) / sd > 2)::INT) AS false_share, count(*) AS n FROM c{m} c JOIN h{m} b ON b.curve_id = c.curve_id AND b.t_idx = c.j JOIN sds ON sds.curve_id = c.curve_id GROUP BY 1)"""


def _false_sql(m: int) -> str:
    part = lambda f, to, sep: sep.join(f(l) for l in range(to))
    return _FNN.format(m=m, cols=part(lambda l: f"lag(x, {l}) OVER w AS e{l}", m + 1, ", "), dims=part(lambda l: f"e{l}", m, ", "), dist=part(lambda l: f"(a.e{l}-b.e{l})*(a.e{l}-b.e{l})", m, " + "))


@query(f"""WITH {_EV}, sds AS (SELECT curve_id, stddev_pop(x) AS sd FROM ev GROUP BY 1), {_false_sql(1)}, {_false_sql(2)}, {_false_sql(3)}
SELECT curve_id, dimension, round(false_share,6) AS false_share, n FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)""")
def false_neighbours(spark, d):
    return nbr.false_neighbours(events(spark, d), "x", 1, 3, 2)


@query(f"""WITH {_EV}, pd AS (SELECT a.curve_id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS dd FROM ev a JOIN ev b ON a.curve_id = b.curve_id AND b.t_idx - a.t_idx > 2 WHERE a.x + a.y IS NOT NULL AND b.x + b.y IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY dd) AS r, count(*) OVER (PARTITION BY curve_id) AS n FROM pd) SELECT curve_id, round(dd,6) AS radius FROM rk WHERE r = greatest(1, ceil(n * 0.07::DOUBLE - 1e-9))""")
def target_rate_radius(spark, d):
    return nbr.radius_for_rate(events(spark, d), ("x", "y"), 0.07, 2)


#: The stated query set, curves with an id divisible by 50, each against all other curves: a pair's key is (query, curve_id).
_CHOSEN = "curve_id % 50 = 0"


_DECLARED = f"{_EV}, qa AS (SELECT curve_id AS query, t_idx, x, y FROM ev WHERE curve_id % 50 = 0)"


@query(f"""WITH {_DECLARED}, pd AS (SELECT query, b.curve_id, abs(a.x-b.x) AS dd FROM qa a JOIN ev b ON b.curve_id <> query WHERE a.x IS NOT NULL AND b.x IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query, curve_id ORDER BY dd) AS r, count(*) OVER (PARTITION BY query, curve_id) AS n FROM pd) SELECT query, curve_id, round(dd,6) AS radius FROM rk WHERE r = greatest(1, ceil(n * 0.1::DOUBLE - 1e-9))""")
def cross_target_rate_radius(spark, d):
    return tiles.cross_radius_for_rate(events(spark, d), F.expr(_CHOSEN), ("x",), 0.1)


_CROSS = f"{_DECLARED}, pr AS (SELECT query, b.curve_id, a.t_idx AS i, b.t_idx AS j FROM qa a JOIN ev b ON b.curve_id <> query AND abs(a.x-b.x) <= 5)"


@query(f"WITH {_CROSS} SELECT query, curve_id, i, j FROM pr")
def cross_recurrence(spark, d):
    return tiles.cross_recurrence(events(spark, d), F.expr(_CHOSEN), ("x",), 5.0)


@query(f"""WITH {_CROSS}, dg AS (SELECT query, curve_id, j-i AS f, i - row_number() OVER (PARTITION BY query, curve_id, j-i ORDER BY i) AS isl FROM pr), dl AS (SELECT query, curve_id, count(*) AS l FROM dg GROUP BY query, curve_id, f, isl),
vg AS (SELECT query, curve_id, j, i - row_number() OVER (PARTITION BY query, curve_id, j ORDER BY i) AS isl FROM pr), vl AS (SELECT query, curve_id, count(*) AS l FROM vg GROUP BY query, curve_id, j, isl),
en AS (SELECT query, curve_id, -sum(p*ln(p)) AS e FROM (SELECT query, curve_id, count(*)/(sum(count(*)) OVER (PARTITION BY query, curve_id))::DOUBLE AS p FROM dl WHERE l >= 2 GROUP BY query, curve_id, l) GROUP BY 1, 2),
na AS (SELECT query, count(*) AS n_a FROM qa GROUP BY 1), nb AS (SELECT curve_id, count(*) AS n_b FROM ev GROUP BY 1), np AS (SELECT query, curve_id, count(*) AS n_pairs FROM pr GROUP BY 1, 2),
dm AS (SELECT query, curve_id, sum(CASE WHEN l>=2 THEN l ELSE 0 END)/sum(l)::DOUBLE AS det, avg(l) FILTER (l>=2) AS md, max(l) FILTER (l>=2) AS xd, count(*) FILTER (l>=2) AS nd FROM dl GROUP BY 1, 2), vm AS (SELECT query, curve_id, sum(CASE WHEN l>=2 THEN l ELSE 0 END)/sum(l)::DOUBLE AS lam, avg(l) FILTER (l>=2) AS tt, max(l) FILTER (l>=2) AS xv FROM vl GROUP BY 1, 2)
SELECT query, curve_id, n_a, n_b, coalesce(n_pairs, 0) AS n_pairs, round(coalesce(n_pairs, 0)/(n_a*n_b)::DOUBLE,6) AS recurrence_rate, round(det,6) AS determinism, round(md,6) AS mean_diagonal, xd AS max_diagonal, coalesce(nd, 0) AS diagonal_lines, round(e,6) AS diagonal_entropy, round(lam,6) AS laminarity, round(tt,6) AS trapping_time, xv AS max_vertical
FROM na JOIN nb ON curve_id <> query LEFT JOIN np USING (query, curve_id) LEFT JOIN dm USING (query, curve_id) LEFT JOIN vm USING (query, curve_id) LEFT JOIN en USING (query, curve_id)""")
def cross_rqa_metrics(spark, d):
    return tiles.cross_rqa(events(spark, d), F.expr(_CHOSEN), ("x",), 5.0)


@query(f"""WITH {_EV}, nb AS (SELECT a.curve_id, a.t_idx AS i, b.t_idx AS j FROM ev a JOIN ev b ON a.curve_id = b.curve_id AND abs(a.t_idx-b.t_idx) > 2 WHERE sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= 30),
m AS (SELECT n.curve_id, n.i, k, avg(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))) AS dd, count(*) AS c FROM nb n, (SELECT unnest(range(0,4)) AS k) h JOIN ev a ON a.curve_id = n.curve_id AND a.t_idx = n.i + k JOIN ev b ON b.curve_id = n.curve_id AND b.t_idx = n.j + k GROUP BY 1,2,3)
SELECT curve_id, k, round(avg(ln(dd)),6) AS mean_log, count(*) AS n FROM m WHERE c >= 2 AND dd > 0 GROUP BY 1,2""")
def kantz_divergence(spark, d):
    return rec.kantz_curve(events(spark, d), ("x", "y"), 30.0, 2, 3)


@query(f"""WITH {_EV}, s AS (SELECT curve_id, t_idx, t, x-50 AS a, y, lead(x-50) OVER w AS b, lead(t) OVER w AS t2, lead(y) OVER w AS y2 FROM ev {_W})
SELECT curve_id, t_idx AS i, round(t + a/(a-b)*(t2-t),6) AS t, round(y + a/(a-b)*(y2-y),6) AS y FROM s WHERE a < 0 AND b >= 0""")
def poincare(spark, d):
    return rec.poincare_crossings(events(spark, d), "x", 50.0, "positive", ("y",))


def _states(spark, d):
    return events(spark, d).select("curve_id", "t_idx", F.col("state").alias("target"), F.when(F.col("x") > 50, 1).otherwise(0).alias("source"), F.when(F.col("y") > 50, 1).otherwise(0).alias("condition"))


def _te_sql(key: str, src: str, cond: bool = False) -> str:
    c = ", c" if cond else ""
    return f"""h AS (SELECT {key}, t_idx, target AS x, lag(target,1) OVER w AS y, lag(source,1) OVER w AS z{', lag(condition,1) OVER w AS c' if cond else ''} FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY t_idx)),
lt AS (SELECT *, log2((count(*) OVER (PARTITION BY {key}, x, y, z{c}))::DOUBLE * (count(*) OVER (PARTITION BY {key}, y{c})) / ((count(*) OVER (PARTITION BY {key}, y, z{c}))::DOUBLE * (count(*) OVER (PARTITION BY {key}, x, y{c})))) AS local FROM h WHERE y IS NOT NULL AND z IS NOT NULL)"""


_ST = f"{_EV}, st AS (SELECT curve_id, t_idx, state AS target, CASE WHEN x > 50 THEN 1 ELSE 0 END AS source, CASE WHEN y > 50 THEN 1 ELSE 0 END AS condition FROM ev)"


@query(f"WITH {_ST}, {_te_sql('curve_id', 'st')} SELECT curve_id, round(avg(local),6) AS transfer_entropy, count(*) AS n_terms FROM lt GROUP BY 1")
def transfer_entropy(spark, d):
    return info.transfer_entropy(_states(spark, d), 1, 1, 1)


@query(f"WITH {_ST}, {_te_sql('curve_id', 'st')} SELECT curve_id, t_idx, round(local,6) AS local FROM lt")
def local_te(spark, d):
    return info.local_transfer_entropy(_states(spark, d), 1, 1, 1).select("curve_id", "t_idx", "local")


@query(f"WITH {_ST}, {_te_sql('curve_id', 'st', True)} SELECT curve_id, round(avg(local),6) AS transfer_entropy, count(*) AS n_terms FROM lt GROUP BY 1")
def conditional_te(spark, d):
    return info.transfer_entropy(_states(spark, d), 1, 1, 1, condition_history=1)


@query(f"""WITH {_ST}, n AS (SELECT curve_id, count(*) AS n FROM st GROUP BY 1), sh AS (SELECT unnest([3,5,7,11]) AS shift),
rs AS (SELECT st.curve_id, shift, st.t_idx, st.target, s2.source FROM st JOIN n USING (curve_id), sh JOIN st s2 ON s2.curve_id = st.curve_id AND (s2.t_idx + shift) % n.n = st.t_idx),
{_te_sql('curve_id, shift', 'rs')}, nl AS (SELECT curve_id, shift, avg(local) AS te FROM lt GROUP BY 1,2), {_te_sql('curve_id', 'st').replace('h AS', 'h2 AS').replace('lt AS', 'l2 AS').replace('FROM h ', 'FROM h2 ')}, ob AS (SELECT curve_id, avg(local) AS o FROM l2 GROUP BY 1)
SELECT curve_id, round(o,6) AS observed, count(*) AS n_shifts, round((1 + count(*) FILTER (te >= o - 1e-12))/(1.0 + count(*))::DOUBLE,6) AS p_value FROM nl JOIN ob USING (curve_id) GROUP BY curve_id, o""")
def te_shift_test(spark, d):
    return info.circular_shift_test(_states(spark, d), [3, 5, 7, 11], 1, 1, 1)


@query(f"""WITH {_EV}, r AS (SELECT curve_id, observed, t_idx - row_number() OVER (PARTITION BY curve_id, observed ORDER BY t_idx) AS run FROM ev), g AS (SELECT curve_id, observed, run, count(*) AS n FROM r GROUP BY 1,2,3)
SELECT curve_id, sum(n)::BIGINT AS n_candidates, sum(CASE WHEN observed = 1 THEN n ELSE 0 END)::BIGINT AS n_observed, coalesce(max(CASE WHEN observed = 0 THEN n END),0) AS longest_missing FROM g GROUP BY 1""")
def longest_runs(spark, d):
    return obs.longest_missing_runs(events(spark, d))


@query(f"WITH {_EV}, p AS (SELECT *, lag(observed) OVER w AS po FROM ev {_W}) SELECT curve_id, t_idx, observed FROM p WHERE po = 1")
def risk_set(spark, d):
    return obs.risk_set(events(spark, d)).select("curve_id", "t_idx", "observed")


@query(f"""WITH {_EV} SELECT curve_id, t_idx, round(last_value(CASE WHEN observed = 1 THEN x END IGNORE NULLS) OVER p,6) AS last_x, t_idx - last_value(CASE WHEN observed = 1 THEN t_idx END IGNORE NULLS) OVER p AS since_observed
FROM ev WINDOW p AS (PARTITION BY curve_id ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def history_state(spark, d):
    return obs.history_state(events(spark, d), ("x",)).select("curve_id", "t_idx", "last_x", "since_observed")


@query(f"""WITH {_EV}, b AS (SELECT *, CASE WHEN t < 0 THEN NULL WHEN t <= 100 THEN 0 WHEN t <= 300 THEN 1 WHEN t <= 500 THEN 2 ELSE 3 END AS bin FROM ev)
SELECT bin, count(*) AS n_candidates, sum(observed)::BIGINT AS n_observed, count(DISTINCT curve_id) AS n_curves FROM b WHERE bin IS NOT NULL GROUP BY bin""")
def time_bin_support(spark, d):
    e = events(spark, d)
    last = e.agg(F.max("t")).first()[0] or 0.0
    return obs.time_bin_support(e, [0.0, 100.0, 300.0, 500.0, max(900.0, last)])


@query(f"""WITH {_EV}, a AS (SELECT avg(x) FILTER (observed=1) m1, avg(x) FILTER (observed=0) m0, var_samp(x) FILTER (observed=1) v1, var_samp(x) FILTER (observed=0) v0 FROM ev) SELECT round(m1,6) AS m1, round(m0,6) AS m0, round((m1-m0)/sqrt((v1+v0)/2),6) AS smd FROM a""")
def smd_association(spark, d):
    return obs.standardized_difference(events(spark, d), "x")


@query(f"""WITH {_EV}, r AS (SELECT curve_id, observed, rank() OVER (PARTITION BY curve_id ORDER BY x) + (count(*) OVER (PARTITION BY curve_id, x) - 1)/2.0 AS r FROM ev) SELECT curve_id, round(corr(r, observed),6) AS association FROM r GROUP BY 1""")
def spearman_association(spark, d):
    return obs.spearman_association(events(spark, d), "x")


@query(f"""WITH {_EV}, s AS (SELECT curve_id, curve_id % 2 AS half, avg(x) AS score FROM ev GROUP BY 1, 2)
SELECT curve_id, round(score,6) AS score, round((1 + (SELECT count(*) FROM s c WHERE c.half <> s.half AND c.score >= s.score))/(1.0 + (SELECT count(*) FROM s c WHERE c.half <> s.half))::DOUBLE,6) AS p_value FROM s""")
def conformal_p(spark, d):
    """Cross-conformal: each half of the curves is calibrated by the other, so every curve gets a p-value."""
    s = events(spark, d).groupBy("curve_id").agg(F.avg("x").alias("score"))
    halves = [s.where(F.col("curve_id") % 2 == k) for k in (0, 1)]
    return inf.conformal_p_values(halves[0], halves[1]).union(inf.conformal_p_values(halves[1], halves[0]))


@query(f"""WITH {_EV}, s AS (SELECT curve_id, avg(x) AS v FROM ev GROUP BY 1), m AS (SELECT quantile_cont(v,0.5) AS m FROM s), d AS (SELECT quantile_cont(abs(v-m),0.5) AS mad FROM s, m) SELECT curve_id, round(v,6) AS v, round(0.67448975*(v-m)/mad,6) AS z FROM s, m, d""")
def robust_z(spark, d):
    return inf.robust_z(events(spark, d).groupBy("curve_id").agg(F.avg("x").alias("v")), "v")


def _span_grid(samples, points=21):
    """Evenly spaced grid from the least to the greatest t of all curves."""
    lo, hi = samples.agg(F.min("t"), F.max("t")).first()
    return np.linspace(float(lo), float(hi), points) if lo is not None else np.zeros(0)


def _grid_table(spark, grid):
    return spark.createDataFrame([(i, float(g)) for i, g in enumerate(grid)], "g_idx long, g double")


@query(f"""WITH {_EV}, sp AS (SELECT min(t) lo, max(t) hi FROM ev), g AS (SELECT i AS g_idx, lo + i * ((hi - lo) / 20) AS g FROM sp, (SELECT unnest(range(0,21)) AS i)), n AS (SELECT g_idx, g, t-g AS dd, 0.75*(1-pow((t-g)/60,2)) AS k, x FROM ev JOIN g ON abs(t-g) < 60),
m AS (SELECT g_idx, g, count(*) AS n, sum(k) s0, sum(k*dd) s1, sum(k*dd*dd) s2, sum(k*x) t0, sum(k*dd*x) t1 FROM n GROUP BY 1,2) SELECT g_idx, round(g,6) AS g, n, round(CASE WHEN n >= 3 THEN (s2*t0-s1*t1)/(s0*s2-s1*s1) END,6) AS mean FROM m""")
def local_linear_mean(spark, d):
    e = events(spark, d)
    return sparse.local_linear_mean(e, _grid_table(spark, _span_grid(e)), 60.0)


@query(f"""WITH {_EV}, e AS (SELECT curve_id, t_idx, t, x - avg(x) OVER () AS e FROM ev) SELECT a.curve_id, count(*) AS n_pairs, round(avg(a.e*b.e),6) AS mean_product FROM e a JOIN e b ON a.curve_id = b.curve_id AND a.t_idx <> b.t_idx GROUP BY 1""")
def raw_cov_pairs(spark, d):
    e = events(spark, d)
    m = e.agg(F.avg("x").alias("m"))
    r = e.crossJoin(F.broadcast(m)).withColumn("e", F.col("x") - F.col("m"))
    return sparse.raw_covariance_pairs(r).groupBy("curve_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("c").alias("mean_product"))


@query(f"""WITH {_EV}, g AS (SELECT curve_id, count(x) k, avg(x) m, var_samp(x) v FROM ev GROUP BY 1), a AS (SELECT sum(k)::DOUBLE n, count(*)::DOUBLE q, sum(k*m) s, sum((k-1)*v) ssw, sum(k*m*m) sb, sum(k*k)::DOUBLE kk FROM g),
b AS (SELECT s/n AS mean, ssw/(n-q) AS msw, greatest(0, ((sb-s*s/n)/(q-1) - ssw/(n-q))/((n-kk/n)/(q-1))) AS between FROM a) SELECT round(mean,6) AS mean, round(between,6) AS between, round(msw,6) AS within, round(between/(between+msw),6) AS icc FROM b""")
def variance_decomposition(spark, d):
    return inf.variance_components(events(spark, d), "x", "curve_id")


_T64 = np.linspace(0, 1, 64)


@query()
def fpca_spectrum(spark, d):
    fit = dec.fit_fpca(dist.curve_arrays(embeddings(spark, d)), _T64, 8)
    return spark.createDataFrame([tuple(s.values()) for s in dec.spectrum(fit)], "component int, eigenvalue double, ratio double, cumulative double, gap double, relative_gap double, next_ratio double")


@query()
def fpca_scores(spark, d):
    a = dist.curve_arrays(embeddings(spark, d))
    fit = dec.fit_fpca(a, _T64, 4)
    return dec.scores(a, fit).select("curve_id", *(F.col("scores")[k].alias(f"score_{k + 1}") for k in range(4)))


@query()
def fpca_reconstruction_error(spark, d):
    a = dist.curve_arrays(embeddings(spark, d))
    return dec.reconstruction_error(a, dec.fit_fpca(a, _T64, 4))


@query()
def fpca_conformal_anomaly(spark, d):
    a = dist.curve_arrays(embeddings(spark, d))
    fold = F.pmod("curve_id", F.lit(3))
    out = None
    for k in range(3):  # the folds rotate: each is fitted on, calibrates and is tested once
        fit = dec.fit_fpca(a.where(fold == k), _T64, 4)
        e = dec.reconstruction_error(a.where(fold != k), fit).select("curve_id", F.col("rmse").alias("score"))
        p = inf.conformal_p_values(e.where(fold == (k + 1) % 3), e.where(fold == (k + 2) % 3))
        out = p if out is None else out.union(p)
    return out


@query()
def bootstrap_stability(spark, d):
    s = dec.bootstrap_stability(dist.curve_arrays(embeddings(spark, d)), _T64, 3, 40)
    return s.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("mean"), F.percentile("similarity", 0.05).alias("q05"))


@query()
def functional_mean_band(spark, d):
    mean, se, c = inf.multiplier_mean_band(dist.curve_arrays(embeddings(spark, d)))
    return spark.createDataFrame([(i, float(m), float(s), float(m - c * s), float(m + c * s)) for i, (m, s) in enumerate(zip(mean, se, strict=True))], "t_idx int, mean double, se double, lower double, upper double")


@query()
def wild_bootstrap(spark, d):
    rows = events(spark, d).groupBy("curve_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumnRenamed("curve_id", "unit")
    return inf.wild_slope_bootstrap(rows, "x", "y", 200)


@query()
def dtw_pairs(spark, d):
    return tiles.alignment_distances(*_query_arrays(spark, d), "symmetric2")


@query()
def dtw_paths(spark, d):
    """Paths of the stated query set inside a band of eight samples, with what each step adds."""
    return tiles.alignment_paths(*_query_arrays(spark, d), "symmetric2", window=8)


@query()
def frechet_pairs(spark, d):
    return tiles.alignment_distances(*_query_arrays(spark, d), "frechet")


@query()
def gee_fit(spark, d):
    rows = events(spark, d).select("curve_id", "observed", F.lit(1.0).alias("one"), (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"))
    beta, cov = inf.logistic_gee(rows, "observed", ["one", "x", "y"], "curve_id")
    return spark.createDataFrame([(n, float(b), float(v**0.5)) for n, b, v in zip(("intercept", "x", "y"), beta, np.diag(cov), strict=True)], "term string, estimate double, robust_se double")


def _sparse_fit(spark, d, dims=("x",), noise=None):
    """Sparse components of the event curves over their whole span; a bandwidth of a quarter of it."""
    e = events(spark, d)
    grid = _span_grid(e, 9)
    width = float(grid[-1] - grid[0]) / 4
    return e, sf.fit(e, grid, 2, width, width, dims, noise=noise)


@query()
def pace_scores(spark, d):
    e, fit = _sparse_fit(spark, d)
    return sf.score_frame(sf.pace_scores(e, fit))


@query()
def sparse_planar_scores(spark, d):
    e = events(spark, d)
    v = e.agg(F.var_samp("x"), F.var_samp("y")).first()
    _, fit = _sparse_fit(spark, d, ("x", "y"), [0.9 * v[0], 0.9 * v[1]])
    return sf.score_frame(sf.pace_scores(e, fit))


@query()
def sparse_partial_prediction(spark, d):
    e, fit = _sparse_fit(spark, d)
    return sf.partial_prediction(e, fit, float(fit.grid[5])).drop("channel")


@query(f"""WITH {_EV} SELECT count(DISTINCT curve_id) AS n_curves, count(*) AS n_samples, 0::BIGINT AS duplicate_times, 0::BIGINT AS short_curves, count(*) FILTER (x IS NULL) AS missing_x, count(*) FILTER (y IS NULL) AS missing_y FROM ev""")
def workflow_preflight(spark, d):
    from . import workflows

    return workflows.preflight(events(spark, d), ("x", "y"))


@query()
def smoothed_savgol(spark, d):
    from ..operators import smoothing

    return smoothing.smooth(events(spark, d), ("x",), "savgol", 7, 2).select("curve_id", "t_idx", "x")


@query()
def resample_pchip(spark, d):
    from ..operators import smoothing

    e = events(spark, d)
    return smoothing.resample_pchip(e, _span_grid(e), max_gap=1000.0)


@query()
def surrogate_test(spark, d):
    from ..operators import smoothing

    return smoothing.surrogate_test(events(spark, d), ("x", "y"), smoothing.time_reversal)


@query()
def mixed_fit(spark, d):
    from ..operators import mixed

    fit = mixed.random_intercept_fit(events(spark, d), "x", ["y"], "curve_id")
    return spark.createDataFrame([(float(fit["beta"][0]), float(fit["beta"][1]), fit["residual_variance"], fit["intercept_variance"])], "intercept double, slope double, residual_variance double, intercept_variance double")


@query()
def fpca_cross_validation(spark, d):
    from ..operators import mixed

    return spark.createDataFrame(mixed.cross_validate_reconstruction(dist.curve_arrays(embeddings(spark, d)), _T64, [1, 2, 4, 8]))


@query()
def fpca_group_influence(spark, d):
    from ..operators import mixed

    rows = embeddings(spark, d)
    arrays = dist.curve_arrays(rows).join(rows.select("curve_id", "participant").distinct(), "curve_id")
    return mixed.group_influence(arrays, "participant", _T64, 3)


@query()
def simulated_process(spark, d):
    from ..operators import simulation

    return simulation.simulate_functional_process(spark, 200, 21, [2.0, 0.5], noise=0.1, dropout=0.1).drop("scores")


@query()
def te_parameter_grid(spark, d):
    return info.parameter_sensitivity(_states(spark, d), [1, 2], [1, 2], [1, 2])


@query()
def kmeans_scores(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    a = dist.curve_arrays(embeddings(spark, d))
    s = dec.scores(a, dec.fit_fpca(a, _T64, 4)).withColumn("features", array_to_vector("scores"))
    return KMeans(k=4, seed=1).fit(s).transform(s).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_REC}, bo AS (SELECT curve_id, i AS a, j AS b FROM pr UNION ALL SELECT curve_id, j, i FROM pr),
re AS (SELECT curve_id, t_idx AS a, t_idx AS b FROM ev UNION SELECT re.curve_id, re.a, bo.b FROM re JOIN bo ON bo.curve_id = re.curve_id AND bo.a = re.b),
lb AS (SELECT curve_id, a, min(b) AS l FROM re GROUP BY 1, 2), sz AS (SELECT curve_id, l, count(*) AS n FROM lb GROUP BY 1, 2) SELECT curve_id, count(*) AS n_components, max(n) AS largest_component FROM sz GROUP BY 1""")
def recurrence_network_components(spark, d):
    return rec.components_within(events(spark, d), ("x",), 5.0, 1)


@query(f"""WITH {_REC}, p2 AS (SELECT a.curve_id, a.t_idx AS i, b.t_idx AS j FROM ev a JOIN ev b ON a.curve_id = b.curve_id AND b.t_idx - a.t_idx > 1 WHERE abs(a.y-b.y) <= 10), jn AS (SELECT curve_id, count(*) AS joint FROM (SELECT * FROM pr INTERSECT SELECT * FROM p2) GROUP BY 1),
al AS (SELECT curve_id, 'x' AS system, count(*) AS n_pairs FROM pr GROUP BY 1 UNION ALL SELECT curve_id, 'y', count(*) FROM p2 GROUP BY 1) SELECT curve_id, system, n_pairs, round(coalesce(joint,0)/n_pairs::DOUBLE,6) AS joint_share FROM al LEFT JOIN jn USING (curve_id)""")
def joint_recurrence_components(spark, d):
    e, p = _rec(spark, d)
    q = rec.recurrence_pairs(e, ("y",), 10.0, 1)
    return rec.joint_components({"x": p, "y": q}, rec.joint_pairs(p, q))


@query(f"""WITH {_SHARES} SELECT count(*) AS n_points, count(*) FILTER (least(a,b,c) < -1e-7) AS negative, count(*) FILTER (abs(a+b+c-1) > 1e-7 + 1e-5) AS not_closed FROM sh""")
def simplex_check(spark, d):
    return geo.simplex_violations(_shares(spark, d), ("a", "b", "c"))


@query(f"""WITH {_EV}, e AS (SELECT curve_id, t_idx, x - avg(x) OVER (PARTITION BY curve_id) AS e FROM ev), v AS (SELECT curve_id, avg(e*e) AS v FROM e GROUP BY 1), l AS (SELECT unnest(range(0,4)) AS lag),
p AS (SELECT a.curve_id, lag, a.e AS e, b.e AS f FROM e a JOIN l ON true JOIN e b ON b.curve_id = a.curve_id AND b.t_idx = a.t_idx + lag), c AS (SELECT p.curve_id, lag, count(*) AS n, sum(e*f) AS s, sum((e-f)*(e-f)) AS d, any_value(v) AS v FROM p JOIN v USING (curve_id) GROUP BY 1, 2)
SELECT lag, sum(n)::BIGINT AS n_pairs, round(sum(s)/sum(n),6) AS autocovariance, round(sum(s/v)/sum(n),6) AS autocorrelation, round(sum(d)/(2*sum(n)),6) AS semivariance FROM c GROUP BY lag""")
def residual_dependence(spark, d):
    e = events(spark, d)
    mean = e.groupBy("curve_id").agg(F.avg("x").alias("m"))
    rows = e.join(mean, "curve_id").withColumn("r", F.col("x") - F.col("m")).withColumn("participant", F.col("curve_id"))
    arrays = rows.groupBy("curve_id", "participant").agg(F.array_sort(F.collect_list(F.struct("t_idx", "r"))).alias("s")).select("curve_id", "participant", F.col("s.r").alias("residual"))
    return fm.residual_diagnostics(arrays, 3)


@query(f"""WITH {_EM}, p AS (SELECT participant, t_idx, avg(x) AS m FROM em GROUP BY 1, 2) SELECT t_idx, round(avg(m),6) AS mean, round(stddev_samp(m)/sqrt(count(*)),6) AS se FROM p GROUP BY 1""")
def participant_mean_se(spark, d):
    a = inf.unit_means(_labelled(spark, d), "participant")
    return a.select(F.posexplode("values").alias("t_idx", "x")).groupBy("t_idx").agg(F.avg("x").alias("mean"), (F.stddev_samp("x") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def _labelled(spark, d):
    """Embedding curves as arrays with their label (participant), a share of positive values (up) and a predictor in [0, 1) made of the id (z)."""
    e = embeddings(spark, d)
    up = F.size(F.filter("values", lambda v: v > 0)) / F.size("values")
    return dist.curve_arrays(e).join(e.select("curve_id", "participant").distinct(), "curve_id").withColumns({"up": up, "z": F.pmod(F.col("curve_id") * 7919, F.lit(101)) / 101.0})


@query(f"""WITH {_EM}, z AS (SELECT vec_id AS curve_id, ((vec_id * 7919) % 101) / 101.0::DOUBLE AS z FROM embeddings), f AS (SELECT t_idx, regr_slope(x, z) b, regr_intercept(x, z) a, avg(z) m, regr_sxx(x, z) sxx, count(*) n FROM em JOIN z USING (curve_id) GROUP BY 1),
h AS (SELECT t_idx, sum(pow((z-m)*(x-a-b*z)/sxx,2)) AS s FROM em JOIN z USING (curve_id) JOIN f USING (t_idx) GROUP BY 1)
SELECT t_idx AS place, round(b,6) AS estimate, round(sqrt(n/(n-2.0::DOUBLE)*s),6) AS se FROM f JOIN h USING (t_idx)""")
def fosr_robust_slope(spark, d):
    m = fos.fit(fos.design(_labelled(spark, d), ["z"]), ["z"])
    return fos.coefficient_frame(spark, m).where("coefficient = 'z'").select("place", "estimate", "se")


@query()
def fosr_simultaneous_bands(spark, d):
    rows = fos.design(_labelled(spark, d), ["z", "up"])
    m = fos.fit(rows, ["z", "up"])
    return fos.coefficient_frame(spark, m, fos.bootstrap(rows, m, 200))


@query()
def generalized_functions(spark, d):
    rows = _labelled(spark, d).withColumn("values", F.transform("values", lambda v: F.when(v > 0, 1.0).otherwise(0.0)))
    return gen.coefficient_frame(spark, gen.fit(gen.model_rows(rows, ["z"], "participant"), _T64, ["z"], "binomial", 5))


@query()
def mixed_functions(spark, d):
    m = fm.fit(_labelled(spark, d), fm.layout(_T64, ["z"], 5, 3), "participant")
    return fm.coefficient_frame(spark, m)


@query()
def score_regression_cv(spark, d):
    return spark.createDataFrame(sr.summarise(sr.cross_validate(_labelled(spark, d), _T64, "up", [1, 2, 4, 8])))


@query()
def score_regression_slope_band(spark, d):
    a = _labelled(spark, d)
    return spark.createDataFrame(sr.slope_band(sr.bootstrap_regression(a, _T64, "up", 3, 50), sr.train(a, _T64, "up", 3)))


@query()
def wild_projection_family(spark, d):
    a = _labelled(spark, d)
    scored = dec.scores(a, dec.fit_fpca(a, _T64, 3)).join(a.select("curve_id", "up"), "curve_id")
    targets = scored.where("curve_id % 50 = 0").select("curve_id", "scores").orderBy("curve_id").toPandas()  # the stated query set
    return wild.family_test(spark, wild.wild_projection(scored, "up", targets, 2, 3, 200))


def _bootstrap(spark, d):
    a = _labelled(spark, d)
    fit = dec.fit_fpca(a, _T64, 3)
    return a, fit, dec.bootstrap_fits(a, _T64, 3, 40, reference=fit)


@query()
def fpca_component_bands(spark, d):
    _, fit, boot = _bootstrap(spark, d)
    return stab.component_bands(boot, fit)


@query()
def fpca_spectrum_uncertainty(spark, d):
    _, fit, boot = _bootstrap(spark, d)
    return stab.spectrum_uncertainty(boot, fit)


@query()
def fpca_score_uncertainty(spark, d):
    a, fit, boot = _bootstrap(spark, d)
    return stab.score_uncertainty(boot, fit, a)


_MBD = f"""{_EM}, rk AS (SELECT curve_id, t_idx, t, x, rank() OVER (PARTITION BY t_idx ORDER BY x) - 1 AS below, count(*) OVER (PARTITION BY t_idx, x) AS c, count(*) OVER (PARTITION BY t_idx) AS n FROM em),
sh AS (SELECT curve_id, t_idx, t, x, 1 - (below*(below-1)/2 + (n-below-c)*(n-below-c-1)/2)/(n*(n-1)/2)::DOUBLE AS share FROM rk), dp AS (SELECT curve_id, sum(share*{_TW}) AS depth FROM sh GROUP BY 1)"""


@query(f"WITH {_MBD} SELECT curve_id, round(depth,6) AS depth FROM dp")
def modified_band_depth(spark, d):
    return outl.modified_band_depth(embeddings(spark, d))


@query(f"""WITH {_MBD}, ct AS (SELECT min(depth) AS cut FROM (SELECT depth, row_number() OVER (ORDER BY depth DESC) AS r, count(*) OVER () AS n FROM dp) WHERE r <= ceil(n * 0.5::DOUBLE)),
rg AS (SELECT t_idx, min(x) AS lo, max(x) AS hi FROM em WHERE curve_id IN (SELECT curve_id FROM dp, ct WHERE depth >= cut - 1e-12) GROUP BY 1),
ou AS (SELECT curve_id, count(*) FILTER (x < lo - 0.2*(hi-lo) OR x > hi + 0.2*(hi-lo)) AS times_outside FROM em JOIN rg USING (t_idx) GROUP BY 1)
SELECT curve_id, round(depth,6) AS depth, depth >= cut - 1e-12 AS central, times_outside, times_outside > 0 AS outlier FROM dp JOIN ou USING (curve_id), ct""")
def functional_boxplot(spark, d):
    return outl.functional_boxplot(embeddings(spark, d), factor=0.2)[1]


@query(f"""WITH {_EM}, md AS (SELECT t_idx, median(x) AS m FROM em GROUP BY 1), aw AS (SELECT curve_id, t_idx, x - m AS dd FROM em JOIN md USING (t_idx)), sp AS (SELECT t_idx, median(abs(dd))/0.6744897501960817::DOUBLE AS sd FROM aw GROUP BY 1),
o AS (SELECT curve_id, dd/sd AS o, {_TW} AS w FROM aw JOIN sp USING (t_idx)) SELECT curve_id, round(sum(o*w),6) AS magnitude, round(sum(o*o*w) - sum(o*w)*sum(o*w),6) AS shape FROM o GROUP BY 1""")
def directional_outlyingness(spark, d):
    return outl.directional_outlyingness(embeddings(spark, d))


@query(f"""WITH {_EV}, ph AS (SELECT curve_id, x, 1/sqrt(750::DOUBLE) AS a, sqrt(2/750::DOUBLE)*sin(2*pi()*t/750) AS b, sqrt(2/750::DOUBLE)*cos(2*pi()*t/750) AS c FROM ev WHERE t BETWEEN 0 AND 750 AND x IS NOT NULL),
g AS (SELECT curve_id, count(*) AS n, sum(a*a) AS aa, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*b) AS bb, sum(b*c) AS bc, sum(c*c) AS cc, sum(a*x) AS ya, sum(b*x) AS yb, sum(c*x) AS yc FROM ph GROUP BY 1),
dt AS (SELECT *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) AS dd FROM g WHERE n >= 3)
SELECT curve_id, n, round((ya*(bb*cc-bc*bc) - ab*(yb*cc-bc*yc) + ac*(yb*bc-bb*yc))/dd,5) AS c0, round((aa*(yb*cc-bc*yc) - ya*(ab*cc-bc*ac) + ac*(ab*yc-yb*ac))/dd,5) AS c1, round((aa*(bb*yc-yb*bc) - ab*(ab*yc-yb*ac) + ya*(ab*bc-bb*ac))/dd,5) AS c2 FROM dt""")
def fourier_projection(spark, d):
    p = bas.project(events(spark, d), "fourier", 3, (0.0, 750.0)).where("failure is null")
    return p.select("curve_id", "n", *(F.round(F.col("coefficients")[k], 5).alias(f"c{k}") for k in range(3)))


@query()
def spline_projection(spark, d):
    p = bas.project(events(spark, d), "bspline", 6, (0.0, 750.0))
    return p.select("curve_id", "n", *(F.col("coefficients")[k].alias(f"c{k}") for k in range(6)), "rmse", "failure")


def _declared_fit(k: int = 3) -> dec.Decomposition:
    """Cosines of half periods as components, orthonormal under the trapezoid weights, and a mean of zero."""
    w = dec.trapezoid_weights(_T64)
    c = np.sqrt(2) * np.cos(np.pi * np.outer(np.arange(1, k + 1), _T64))
    return dec.Decomposition(np.zeros(64), c, np.ones(k), np.full(k, 1 / k), w, 1.0)


_DS = f"{_EM}, sc AS (SELECT curve_id, k, sum(x * sqrt(2) * cos(pi() * k * t) * {_TW}) AS s FROM em, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1, 2)"


@query(f"WITH {_DS} SELECT curve_id, k::INT AS component, round(s,6) AS score FROM sc")
def scores_on_declared_components(spark, d):
    s = dec.scores(dist.curve_arrays(embeddings(spark, d)), _declared_fit())
    return s.select("curve_id", F.posexplode("scores").alias("k", "score")).select("curve_id", (F.col("k") + 1).alias("component"), "score")


@query(f"""WITH {_DS}, ft AS (SELECT curve_id, t_idx, x - (SELECT sum(s * sqrt(2) * cos(pi() * k * em.t)) FROM sc WHERE sc.curve_id = em.curve_id) AS e FROM em)
SELECT curve_id, round(sqrt(sum(e*e*{_TW})),6) AS rmse FROM ft GROUP BY 1""")
def reconstruction_from_declared_components(spark, d):
    return dec.reconstruction_error(dist.curve_arrays(embeddings(spark, d)), _declared_fit())


@query(f"""WITH {_EM}, pv AS (SELECT t_idx, var_samp(x) * {_TW} AS v FROM em GROUP BY t_idx) SELECT round(sum(v),6) AS total_variance, 1.0::DOUBLE AS norm, 0.0::DOUBLE AS overlap FROM pv""")
def fpca_total_variance(spark, d):
    """What all components explain is the integrated variance; components have norm one and don't overlap."""
    f = dec.fit_fpca(dist.curve_arrays(embeddings(spark, d)), _T64, 4)
    g = (f.components * f.weights) @ f.components.T
    return spark.createDataFrame([(float(f.explained_variance[0] / f.ratio[0]), float(np.diag(g).mean()), float(np.abs(np.round(g - np.diag(np.diag(g)), 9)).max()))], "total_variance double, norm double, overlap double")


_BAL = """em4 AS (SELECT vec_id, vec_id % 10 AS p, embedding[i]::DOUBLE + 0.1 * (vec_id % 10) AS y FROM embeddings, (SELECT unnest(range(1, 5)) AS i)), z AS (SELECT count(DISTINCT p) AS p, count(*)/count(DISTINCT p) AS m, avg(y) AS mu FROM em4),
pm AS (SELECT p, avg(y) AS m FROM em4 GROUP BY 1), wi AS (SELECT sum((y - m)*(y - m)) AS ss FROM em4 JOIN pm USING (p)), be AS (SELECT sum((pm.m - mu)*(pm.m - mu)) AS ss FROM pm, z)"""


@query(f"""WITH {_BAL} SELECT round(mu,4) AS estimate, round(wi.ss/(p*(m-1)),4) AS residual_variance, round((be.ss/(p-1)) - wi.ss/(p*(m-1))/m,4) AS participant_variance FROM z, wi, be""")
def mixed_random_intercept(spark, d):
    """Ten participants with as many curves each (ids by remainder) and one constant random effect: restricted likelihood is the analysis of variance."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    arrays = v.select(F.col("vec_id").alias("curve_id"), (F.col("vec_id") % 10).alias("participant"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") + F.col("vec_id") % 10 * 0.1).alias("values"))
    one = np.ones((4, 1))
    m = fm.fit(arrays, fm.Layout(np.arange(4.0), ("intercept",), one, one), "participant", tolerance=1e-9)
    factor, _, sd, _ = m.layout.unpack(m.theta)
    return spark.createDataFrame([tuple(round(float(x), 4) for x in (m.beta[0, 0], sd * sd, factor[0, 0] ** 2))], "estimate double, residual_variance double, participant_variance double")


def _planar(spark, d, n: int = 25):
    """Complete planar curves of the event stream in normalised time, on an equidistant grid."""
    grid = spark.range(n).select(F.col("id").cast("int").alias("g_idx"), (F.col("id") / F.lit(n - 1.0)).alias("g"))
    rows = geo.resample_linear(geo.normalize_time(events(spark, d)), grid, ("x", "y")).withColumnRenamed("g_idx", "t_idx")
    return dist.curve_arrays(rows, ("x", "y")).where(~F.exists("values", lambda v: v.isNull()))


@query()
def elastic_fpca(spark, d):
    a = _planar(spark, d)
    fit = elastic.fit_elastic_fpca(a, np.linspace(0, 1, 25), 3, rounds=40, tolerance=0.02)
    s = elastic.elastic_scores(a, fit)
    return s.select("curve_id", *(F.col("scores")[k].alias(f"score_{k + 1}") for k in range(3)), F.col("warp")[12].alias("half_time"), "amplitude", "phase")


@query()
def fpca_subspace_stability(spark, d):
    return stab.summarise_subspace_stability(stab.subspace_stability(_bootstrap(spark, d)[2]))


@query()
def fpca_outliers(spark, d):
    a = _labelled(spark, d)
    fit = dec.fit_fpca(a, _T64, 4)
    return stab.diagnose_outliers(dec.reconstruction_error(a, fit), dec.scores(a, fit), 4)


@query()
def windowed_rqa_mean_band(spark, d):
    w = rec.windowed_rqa(embeddings(spark, d), ("x",), 0.02, 16, 8)  # curves of one length share their windows
    return rec.windowed_mean_band(w, "recurrence_rate", 200)
