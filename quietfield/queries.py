"""Queries over the driver's tables, one for each operator, and the SQL that checks them.

Each takes its whole tables. Values are rounded, as sums of floats depend on their order.
"""

from __future__ import annotations


from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.functions import linalg as L
from quietfield.operators import asr, denoisers, density, dss, head, lines, moments, qa, references, series, spans, spectral, transforms, views, windows
from quietfield.plans import validation
from quietfield.plans.model import apply_long, fitted_covariance, matrix_table
from quietfield.sources import signals as S
from quietfield.streaming import streams

FLAGSHIP = "residual_variance_ratio"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 24
OFF = 0.00001234567

HOURLY = """WITH g AS (SELECT event_type AS channel, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, sum(value) AS x FROM events GROUP BY 1, 2),
b AS (SELECT min(h) AS lo, max(h) AS hi FROM g),
sig AS (SELECT c.channel, r.h - b.lo AS t, coalesce(g.x, 0.0) AS x FROM (SELECT DISTINCT channel FROM g) c CROSS JOIN b
  CROSS JOIN (SELECT unnest(range((SELECT lo FROM b), (SELECT hi + 1 FROM b))) AS h) r LEFT JOIN g ON g.channel = c.channel AND g.h = r.h),
nn AS (SELECT max(t) + 1 AS n FROM sig)"""
SMOOTH = HOURLY + ",\nsm AS (SELECT channel, t, x, avg(x) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS y FROM sig)"
#: Periodograms of the whole length, before and after (the residual of the daily mean), between the bins 0 and n / 2.
PSD = SMOOTH + """,
bins AS (SELECT unnest(range(1, (SELECT CAST((n + 1) // 2 AS BIGINT) FROM nn))) AS k),
z AS (SELECT channel, k, any_value(n) AS n, sum(x * cos(2 * pi() * ((k * t) % n) / n)) AS xr, sum(x * sin(2 * pi() * ((k * t) % n) / n)) AS xi,
  sum((x - y) * cos(2 * pi() * ((k * t) % n) / n)) AS yr, sum((x - y) * sin(2 * pi() * ((k * t) % n) / n)) AS yi FROM sm CROSS JOIN bins CROSS JOIN nn GROUP BY 1, 2),
p AS (SELECT channel, CAST(k AS BIGINT) AS k, n, k * 24.0 / n AS freq, 2 * (xr * xr + xi * xi) / (n * 24) AS pb, 2 * (yr * yr + yi * yi) / (n * 24) AS pa FROM z)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(x: Column | str, digits: int = 4) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def shown(df: DataFrame, *exact: str, digits: int = 4, nudge: float = 0.0) -> DataFrame:
    """``nudge`` (in the SQL as well) moves values off the ties of rounding, where sums of few decimals can lie."""
    return df.select(*exact, *[r(F.col(c) + nudge if nudge else F.col(c), digits).alias(c) for c in df.columns if c not in exact])


def hours(signal: DataFrame) -> int:
    return signal.agg((F.max("t") + 1).alias("n")).first().n or 0


def smooth_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sig = S.hourly(spark, d)
    mean = windows.running_mean(sig, DAY).withColumnRenamed("x", "y")
    return sig, sig.join(mean, ["channel", "t"]).select("channel", "t", (F.col("x") - F.col("y")).alias("x"))


def psd_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    before, after = smooth_pair(spark, d)
    n = hours(before)
    return tuple(transforms.periodogram(s, n, 24.0) for s in (before, after))


# --- windows -------------------------------------------------------------------------------------------------

@query("residual_variance_ratio", SMOOTH + " SELECT channel, round(var_pop(x - y) / var_pop(x), 4) + 0.0 AS ratio FROM sm GROUP BY 1")
def _(spark, d):
    before, after = smooth_pair(spark, d)
    return shown(qa.variance_ratio(before, after), "channel")


@query("running_mean", SMOOTH + " SELECT channel, t, round(y + 0.00001234567, 4) + 0.0 AS x FROM sm")
def _(spark, d):
    return shown(windows.running_mean(S.hourly(spark, d), DAY, block=200), "channel", "t", nudge=OFF)


@query("running_mean_twice", SMOOTH + " SELECT channel, t, round(avg(y) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) + 0.00001234567, 4) + 0.0 AS x FROM sm")
def _(spark, d):
    return shown(windows.running_mean(S.hourly(spark, d), DAY, 2, block=200), "channel", "t", nudge=OFF)


@query("moving_average_zero_filled", HOURLY + " SELECT channel, t, round(sum(x) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) / 12, 4) + 0.0 AS x FROM sig")
def _(spark, d):
    return shown(windows.moving_average(S.hourly(spark, d), 12, block=100), "channel", "t")


@query("lag_average", HOURLY + """ SELECT channel, t, round(coalesce((lag(x, 24) OVER w * (1.0 / 24) + x + lead(x, 24) OVER w * (1.0 / 24)) / (1 + 2.0 / 24), 0.0), 4) + 0.0 AS x
FROM sig WINDOW w AS (PARTITION BY channel ORDER BY t)""")
def _(spark, d):
    return shown(windows.lag_average(S.hourly(spark, d), [-24, 0, 24], "inverse", block=100), "channel", "t")


@query("lag_features", HOURLY + """, l AS (SELECT unnest([-1, 0, 2]) AS lag) SELECT s.channel, CAST(l.lag AS INTEGER) AS lag, s.t, round(p.x, 4) + 0.0 AS x FROM sig s CROSS JOIN l CROSS JOIN nn
JOIN sig p ON p.channel = s.channel AND p.t = s.t - l.lag WHERE s.t >= 2 AND s.t < n - 1""")
def _(spark, d):
    return shown(windows.lag_features(S.hourly(spark, d), [-1, 0, 2], block=100), "channel", "lag", "t")


@query("lagged_pairs", HOURLY + " SELECT a.channel, a.t, round(a.x, 4) + 0.0 AS x, round(b.x, 4) + 0.0 AS past FROM sig a JOIN sig b ON a.channel = b.channel AND b.t = a.t - 3")
def _(spark, d):
    return shown(windows.lagged_pairs(S.hourly(spark, d), 3, block=100), "channel", "t")


MIRROR = HOURLY + """,
m AS (SELECT channel, t, x FROM sig UNION ALL SELECT channel, -1 - t, x FROM sig WHERE t < {w} UNION ALL SELECT channel, 2 * n - 1 - t, x FROM sig CROSS JOIN nn WHERE t >= n - {w}),
lv AS (SELECT channel, t, x, avg(x) OVER f AS mean, greatest(avg(x * x) OVER f - pow(avg(x) OVER f, 2), 0.0) AS v FROM m WINDOW f AS (PARTITION BY channel ORDER BY t ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING)),
own AS (SELECT channel, t, x, mean, v FROM lv CROSS JOIN nn WHERE t >= 0 AND t < n)"""


@query("local_mean", MIRROR.format(w=10, b=5, a=4) + " SELECT channel, t, round(mean, 4) + 0.0 AS mean FROM own")
def _(spark, d):
    sig = S.hourly(spark, d)
    return shown(windows.local_mean(sig, 10, hours(sig), block=100).select("channel", "t", "mean"), "channel", "t")


@query("local_variance", MIRROR.format(w=48, b=24, a=23) + " SELECT channel, t, round(v, 2) + 0.0 AS var FROM own")
def _(spark, d):
    sig = S.hourly(spark, d)
    return shown(windows.local_variance(sig, 48, hours(sig), block=100).select("channel", "t", "var"), "channel", "t", digits=2)


@query("smooth_tanh", MIRROR.format(w=10, b=5, a=4) + " SELECT channel, t, round(tanh(0.01 * mean), 4) + 0.0 AS x FROM own")
def _(spark, d):
    sig = S.hourly(spark, d)
    return shown(denoisers.smooth_tanh(sig, hours(sig), 0.01, 10), "channel", "t")


@query("wiener_mask", MIRROR.format(w=50, b=25, a=24) + """, q AS (SELECT channel, quantile_cont(v, 0.25) AS noise FROM own GROUP BY 1)
SELECT channel, t, round(x * greatest(CASE WHEN v > 0 THEN 1 - noise / v ELSE 0 END, 0.01) + 0.00001234567, 3) + 0.0 AS x FROM own JOIN q USING (channel)""")
def _(spark, d):
    sig = S.hourly(spark, d)
    return shown(denoisers.wiener_mask(sig, hours(sig), 50), "channel", "t", digits=3, nudge=OFF)


@query("variance_mask", MIRROR.format(w=100, b=50, a=49) + """, q AS (SELECT channel, quantile_cont(v, 0.75) AS level, stddev_pop(v) AS s FROM own GROUP BY 1)
SELECT channel, t, round(x / (1 + exp(-(v - level) / s)), 3) + 0.0 AS x FROM own JOIN q USING (channel)""")
def _(spark, d):
    sig = S.hourly(spark, d)
    return shown(denoisers.variance_mask(sig, hours(sig)), "channel", "t", digits=3)


@query("variance_mask_hard", MIRROR.format(w=101, b=50, a=50) + """, q AS (SELECT channel, quantile_cont(v, 0.6) AS level FROM own GROUP BY 1)
SELECT channel, count(*) AS n, CAST(sum(CASE WHEN v >= level - 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM own JOIN q USING (channel) GROUP BY 1""")
def _(spark, d):
    sig = S.hourly(spark, d)
    v = windows.local_variance(sig, 101, hours(sig))
    level = v.groupBy("channel").agg(F.percentile("var", 0.6).alias("level"))
    return v.join(F.broadcast(level), "channel").groupBy("channel").agg(F.count("*").alias("n"), F.sum((F.col("var") >= F.col("level") - 1e-6).cast("long")).alias("kept"))


@query("window_starts_fractional", HOURLY + """, k AS (SELECT 1 + unnest(range(0, 1000)) * (48 * 0.34) AS s) SELECT DISTINCT CAST(floor(s + 0.5) - 1 AS BIGINT) AS start FROM k CROSS JOIN nn WHERE s < n - 48 + 2.2e-16""")
def _(spark, d):
    n = hours(S.hourly(spark, d))
    return spark.createDataFrame([(s,) for s in windows.fractional_starts(n, 48, 0.66)], "start long")


@query("window_rms", HOURLY + """, w AS (SELECT DISTINCT CAST(floor(1 + k * (48 * 0.34) + 0.5) - 1 AS BIGINT) AS start FROM (SELECT unnest(range(0, 1000)) AS k) CROSS JOIN nn WHERE 1 + k * (48 * 0.34) < n - 48 + 2.2e-16)
SELECT channel, start, round(sqrt(sum(x * x) / 48), 4) + 0.0 AS rms FROM sig JOIN w ON t >= start AND t < start + 48 GROUP BY 1, 2""")
def _(spark, d):
    sig = S.hourly(spark, d)
    return shown(windows.window_rms(sig, windows.fractional_starts(hours(sig), 48, 0.66), 48), "channel", "start")


@query("window_concatenation", HOURLY + """, w AS (SELECT unnest([0, 24, 60]) AS start) SELECT channel, CAST(start AS BIGINT) AS start, t - start AS k, round(x, 4) + 0.0 AS x FROM sig JOIN w ON t >= start AND t < start + 48""")
def _(spark, d):
    cut = windows.in_windows(S.hourly(spark, d), [0, 24, 60], 48)
    return cut.select("channel", "start", (F.col("t") - F.col("start")).alias("k"), r("x").alias("x"))


@query("raised_cosine_ramp", HOURLY + " SELECT channel, t, round(x * (1 - cos(pi() * (t % 24 + 1) / 24)) / 2 + 0.00001234567, 4) + 0.0 AS x FROM sig")
def _(spark, d):
    """Every day faded in."""
    return shown(S.hourly(spark, d).select("channel", "t", (F.col("x") * windows.raised_cosine(F.col("t") % DAY + 1, DAY)).alias("x")), "channel", "t", nudge=OFF)


@query("overlap_add", HOURLY + " SELECT channel, t, round(x, 3) + 0.0 AS x FROM sig CROSS JOIN nn WHERE t < CAST(floor((n - 48) / 36) AS BIGINT) * 36 + 48")
def _(spark, d):
    sig = S.hourly(spark, d)
    starts = list(range(0, hours(sig) - 48 + 1, 36))
    return shown(windows.overlap_add(windows.cross_faded(sig, starts, 48, 12)), "channel", "t", digits=3)


@query("odd_reflection", HOURLY + """, e AS (SELECT channel, max(CASE WHEN t = 0 THEN x END) AS a, max(CASE WHEN t = n - 1 THEN x END) AS b FROM sig CROSS JOIN nn GROUP BY 1)
SELECT channel, t, round(x, 4) + 0.0 AS x FROM sig UNION ALL SELECT channel, -t, round(2 * a - x, 4) + 0.0 FROM sig JOIN e USING (channel) WHERE t BETWEEN 1 AND 12
UNION ALL SELECT channel, 2 * (n - 1) - t, round(2 * b - x, 4) + 0.0 FROM sig JOIN e USING (channel) CROSS JOIN nn WHERE t BETWEEN n - 13 AND n - 2""")
def _(spark, d):
    sig = S.hourly(spark, d)
    return shown(windows.odd_reflected(sig, 12, hours(sig)), "channel", "t")


# --- scalar functions ----------------------------------------------------------------------------------------

SCALED = HOURLY + ", sc AS (SELECT channel, t, x / 100 AS x FROM sig)"


def scaled(spark, d):
    return S.hourly(spark, d).withColumn("x", F.col("x") / 100)


@query("tanh_mask", SCALED + " SELECT channel, t, round(s * tanh(x / s), 4) + 0.0 AS x FROM sc JOIN (SELECT channel, stddev_pop(x) AS s FROM sc GROUP BY 1) USING (channel)")
def _(spark, d):
    return shown(denoisers.tanh_mask(scaled(spark, d)), "channel", "t")


@query("robust_tanh", SCALED + " SELECT channel, t, round(x - tanh(x), 4) + 0.0 AS x FROM sc")
def _(spark, d):
    return scaled(spark, d).select("channel", "t", r(denoisers.robust_tanh(F.col("x"))).alias("x"))


@query("gauss_contrast", SCALED + " SELECT channel, t, round(x * exp(-x * x / 2), 4) + 0.0 AS x FROM sc")
def _(spark, d):
    return scaled(spark, d).select("channel", "t", r(denoisers.gauss(F.col("x"))).alias("x"))


@query("skew_contrast", SCALED + " SELECT channel, t, round(x * x, 4) + 0.0 AS x FROM sc")
def _(spark, d):
    return scaled(spark, d).select("channel", "t", r(denoisers.skew(F.col("x"))).alias("x"))


@query("kurtosis_contrasts", SCALED + " SELECT channel, t, round(tanh(x), 4) + 0.0 AS th, round(x * x * x, 3) + 0.0 AS cube, round(x * exp(-x * x / 2), 4) + 0.0 AS ga FROM sc")
def _(spark, d):
    x = F.col("x")
    return scaled(spark, d).select("channel", "t", r(denoisers.kurtosis(x)).alias("th"), r(denoisers.kurtosis(x, "cube"), 3).alias("cube"), r(denoisers.kurtosis(x, "gauss")).alias("ga"))


@query("contrast_betas", SCALED + " SELECT channel, round(-avg(1 - pow(tanh(x), 2)), 5) + 0.0 AS th, -3.0 AS p3, round(-avg((1 - x * x) * exp(-x * x / 2)), 5) + 0.0 AS ga FROM sc GROUP BY 1")
def _(spark, d):
    s = scaled(spark, d)
    out = denoisers.beta(s).select("channel", r("beta", 5).alias("th")).join(denoisers.beta(s, "pow3").select("channel", r("beta", 5).alias("p3")), "channel")
    return out.join(denoisers.beta(s, "gauss").select("channel", r("beta", 5).alias("ga")), "channel")


# --- spans and events ----------------------------------------------------------------------------------------

LOUD = HOURLY + ", q AS (SELECT channel, quantile_cont(x, 0.7) AS q FROM sig GROUP BY 1), mk AS (SELECT channel, t, x, x > q AS loud FROM sig JOIN q USING (channel))"
SPANS = LOUD + ", sp AS (SELECT channel, min(t) AS start, max(t) + 1 AS stop FROM (SELECT channel, t, t - row_number() OVER (PARTITION BY channel ORDER BY t) AS run FROM mk WHERE loud) GROUP BY channel, run)"


def loud(spark, d):
    sig = S.hourly(spark, d)
    q = sig.groupBy("channel").agg(F.percentile("x", 0.7).alias("q"))
    return sig.join(F.broadcast(q), "channel").select("channel", "t", "x", (F.col("x") > F.col("q")).alias("on"))


@query("mask_spans", SPANS + " SELECT channel, start, stop FROM sp")
def _(spark, d):
    return spans.mask_to_spans(loud(spark, d), cell=100)


@query("merged_spans", SPANS + """, w AS (SELECT channel, greatest(start - 3, 0) AS start, stop + 3 AS stop FROM sp),
f AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY channel ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM w),
h AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f) SELECT channel, min(start) AS start, max(stop) AS stop FROM h GROUP BY channel, run""")
def _(spark, d):
    s = spans.mask_to_spans(loud(spark, d)).select("channel", F.greatest(F.col("start") - 3, F.lit(0)).alias("start"), (F.col("stop") + 3).alias("stop"))
    return spans.merge_spans(s)


@query("outside_spans", LOUD + " SELECT channel, count(*) AS n, round(sum(x), 2) + 0.0 AS total FROM mk WHERE NOT loud GROUP BY 1")
def _(spark, d):
    m = loud(spark, d)
    kept = spans.within(m.select("channel", "t", "x"), spans.mask_to_spans(m), "left_anti")
    return kept.groupBy("channel").agg(F.count("*").alias("n"), r(F.sum("x"), 2).alias("total"))


@query("inside_spans", LOUD + " SELECT channel, count(*) AS n, round(sum(x), 2) + 0.0 AS total FROM mk WHERE loud GROUP BY 1")
def _(spark, d):
    m = loud(spark, d)
    kept = spans.within(m.select("channel", "t", "x"), spans.mask_to_spans(m))
    return kept.groupBy("channel").agg(F.count("*").alias("n"), r(F.sum("x"), 2).alias("total"))


@query("span_annotations", SPANS + " SELECT channel, round(start / 24.0, 4) + 0.0 AS onset, round((stop - start) / 24.0, 4) + 0.0 AS duration, 'loud' AS label FROM sp")
def _(spark, d):
    return spans.span_annotations(spans.mask_to_spans(loud(spark, d)), 24.0, "loud").select("channel", r("onset").alias("onset"), r("duration").alias("duration"), "label")


@query("annotation_spans", """SELECT event_id, CAST(floor((epoch(ts) - 1704067200) / 3600.0 * 24) AS BIGINT) AS start, CAST(ceil(((epoch(ts) - 1704067200) / 3600.0 + 0.25) * 24) AS BIGINT) AS stop FROM events WHERE lower(event_type) LIKE 'err%'""")
def _(spark, d):
    e = S.table(spark, d, "events")
    seconds = S.day_number(F.col("ts")) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.date_format("ts", "s.SSSSSS").cast("double")
    notes = e.select("event_id", F.col("event_type").alias("label"), ((seconds - 1704067200) / 3600.0).alias("onset"), F.lit(0.25).alias("duration"))
    return spans.annotation_spans(spans.prefixed(notes, ["ERR"]), 24.0).select("event_id", "start", "stop")


@query("epoch_average", HOURLY + " SELECT s.channel, CAST(floor(s.t / 24) AS BIGINT) AS epoch, s.t % 24 AS t, round(m.m, 4) + 0.0 AS x FROM sig s CROSS JOIN nn JOIN (SELECT channel, t % 24 AS k, avg(x) AS m FROM sig CROSS JOIN nn WHERE t < floor(n / 24) * 24 GROUP BY 1, 2) m ON m.channel = s.channel AND m.k = s.t % 24 WHERE s.t < floor(n / 24) * 24")
def _(spark, d):
    return shown(spans.epoch_average(S.to_epochs(S.hourly(spark, d), DAY)), "channel", "epoch", "t")


@query("epochs_round_trip", HOURLY + " SELECT channel, t, round(x, 4) + 0.0 AS x FROM sig CROSS JOIN nn WHERE t < floor(n / 24) * 24")
def _(spark, d):
    return shown(S.from_epochs(S.to_epochs(S.hourly(spark, d), DAY), DAY), "channel", "t")


@query("cycle_average", HOURLY + """, ev AS (SELECT DISTINCT t AS e FROM sig CROSS JOIN nn WHERE t % 37 = 5 AND t - 6 >= 0 AND t + 12 <= n), k AS (SELECT unnest(range(-6, 12)) AS k),
met AS (SELECT s.channel, s.t, k.k, s.x FROM ev CROSS JOIN k JOIN sig s ON s.t = ev.e + k.k), mean AS (SELECT channel, k, avg(x) AS m FROM met GROUP BY 1, 2),
bk AS (SELECT channel, t, avg(m) AS y FROM met JOIN mean USING (channel, k) GROUP BY 1, 2) SELECT channel, t, round(coalesce(y, 0.0), 4) + 0.0 AS x FROM sig LEFT JOIN bk USING (channel, t)""")
def _(spark, d):
    sig = S.hourly(spark, d)
    events = sig.where("t % 37 = 5").select(F.col("t").alias("event"))
    return shown(spans.cycle_average(sig, events, 6, 12, hours(sig)), "channel", "t")


@query("channel_picks", """SELECT c_custkey AS channel, CASE c_nationkey % 4 WHEN 0 THEN 'eeg' WHEN 1 THEN 'grad' WHEN 2 THEN 'ecg' ELSE 'mag' END AS kind FROM customer WHERE c_nationkey % 4 = 3""")
def _(spark, d):
    k = F.col("c_nationkey") % 4
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("channel"), F.when(k == 0, "eeg").when(k == 1, "grad").when(k == 2, "ecg").otherwise("mag").alias("kind"))
    return S.pick_kind(c)


@query("data_picks", """SELECT c_custkey AS channel FROM customer WHERE c_nationkey % 4 <> 2 AND NOT c_acctbal < 0""")
def _(spark, d):
    k = F.col("c_nationkey") % 4
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("channel"), F.when(k == 0, "eeg").when(k == 1, "grad").when(k == 2, "ecg").otherwise("mag").alias("kind"), (F.col("c_acctbal") < 0).alias("bad"))
    return S.pick_data(c, exclude_bads=True).select("channel")


@query("restored_channels", SMOOTH + " SELECT channel, t, round(CASE WHEN channel IN ('click', 'view') THEN y ELSE x END + 0.00001234567, 4) + 0.0 AS x FROM sm")
def _(spark, d):
    sig = S.hourly(spark, d)
    return shown(S.restore_channels(windows.running_mean(sig.where("channel in ('click', 'view')"), DAY), sig), "channel", "t", nudge=OFF)


# --- moments -------------------------------------------------------------------------------------------------

@query("channel_means", HOURLY + " SELECT channel, round(avg(x), 5) + 0.0 AS mean FROM sig GROUP BY 1")
def _(spark, d):
    return shown(moments.channel_means(S.hourly(spark, d)), "channel", digits=5)


@query("weighted_means", HOURLY + " SELECT channel, round(sum((t + 1) * x) / sum(t + 1), 5) + 0.0 AS mean FROM sig GROUP BY 1")
def _(spark, d):
    return shown(moments.channel_means(S.hourly(spark, d).withColumn("w", F.col("t") + 1.0), "w"), "channel", digits=5)


COV = HOURLY + ", cv AS (SELECT a.channel AS \"row\", b.channel AS col, avg(a.x * b.x) - avg(a.x) * avg(b.x) AS v FROM sig a JOIN sig b USING (t) GROUP BY 1, 2)"


@query("covariance", COV + ' SELECT "row", col, round(v, 3) + 0.0 AS v FROM cv')
def _(spark, d):
    sig = S.hourly(spark, d)
    names = S.channels_of(sig)
    return shown(matrix_table(sig, fitted_covariance(sig)[0], names, names), "row", "col", digits=3)


@query("covariance_shrunk", COV + ", tr AS (SELECT avg(v) AS mu FROM cv WHERE \"row\" = col) SELECT \"row\", col, round(0.9 * v + CASE WHEN \"row\" = col THEN 0.1 * mu ELSE 0 END, 3) + 0.0 AS v FROM cv CROSS JOIN tr")
def _(spark, d):
    sig = S.hourly(spark, d)
    names = S.channels_of(sig)
    return shown(matrix_table(sig, moments.shrunk(fitted_covariance(sig)[0], 0.1), names, names), "row", "col", digits=3)


@query("covariance_vectors", """WITH v AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT 'e' || (a.i - 1) AS "row", 'e' || (b.i - 1) AS col, round(avg(a.x * b.x) - avg(a.x) * avg(b.x), 6) + 0.0 AS v FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2""")
def _(spark, d):
    rows = S.table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("xs"))
    cov, _, _ = moments.covariance(rows)
    names = [f"e{k}" for k in range(len(cov))]
    return shown(matrix_table(rows, cov, names, names), "row", "col", digits=6)


@query("ledoit_wolf", HOURLY + """, mn AS (SELECT channel, avg(x) AS m FROM sig GROUP BY 1), c AS (SELECT s.channel, s.t, s.x - m AS x FROM sig s JOIN mn USING (channel)),
cv AS (SELECT a.channel AS i, b.channel AS j, avg(a.x * b.x) AS v FROM c a JOIN c b USING (t) GROUP BY 1, 2), mu AS (SELECT avg(v) AS mu FROM cv WHERE i = j),
dl AS (SELECT sum(pow(v - CASE WHEN i = j THEN mu ELSE 0 END, 2)) AS delta, sum(v * v) AS f FROM cv CROSS JOIN mu), q AS (SELECT sum(e * e) AS q FROM (SELECT t, sum(x * x) AS e FROM c GROUP BY 1))
SELECT round(least(greatest((q / n - f) / n / delta, 0), 1), 6) + 0.0 AS intensity FROM dl CROSS JOIN q CROSS JOIN nn""")
def _(spark, d):
    sig = S.hourly(spark, d)
    rows = S.by_sample(sig)
    cov, mean, n = moments.covariance(rows)
    return spark.createDataFrame([(round(moments.shrinkage(rows, cov, mean, n), 6),)], "intensity double")


@query("block_covariances", HOURLY + """, fl AS (SELECT channel, t, x FROM sig UNION ALL SELECT channel, n + k, x FROM sig CROSS JOIN nn CROSS JOIN (SELECT unnest(range(0, 100)) AS k) WHERE t = n - 1 AND n % 100 > 0 AND k < 100 - n % 100)
SELECT CAST(floor(a.t / 100) AS BIGINT) AS block, a.channel AS ci, b.channel AS cj, round(sum(a.x * b.x) / 100, 2) + 0.0 AS v FROM fl a JOIN fl b USING (t) GROUP BY 1, 2, 3""")
def _(spark, d):
    sig = S.hourly(spark, d)
    return shown(moments.block_covariances(sig, 100, hours(sig)), "block", "ci", "cj", digits=2)


@query("block_covariances_plain", HOURLY + " SELECT CAST(floor(a.t / 100) AS BIGINT) AS block, a.channel AS ci, b.channel AS cj, round(sum(a.x * b.x) / 100, 2) + 0.0 AS v FROM sig a JOIN sig b USING (t) GROUP BY 1, 2, 3")
def _(spark, d):
    sig = S.hourly(spark, d)
    return shown(moments.block_covariances(sig, 100, hours(sig), padded=False), "block", "ci", "cj", digits=2)


@query("window_covariances", HOURLY + """, w AS (SELECT unnest([0, 50, 100]) AS w) SELECT CAST(w AS BIGINT) AS start, a.channel AS ci, b.channel AS cj, round(covar_samp(a.x, b.x), 2) + 0.0 AS v FROM w JOIN sig a ON a.t >= w AND a.t < w + 80 JOIN sig b ON a.t = b.t GROUP BY 1, 2, 3""")
def _(spark, d):
    p = moments.pair_products(windows.in_windows(S.hourly(spark, d), [0, 50, 100], 80), ["start"])
    return p.select("start", "ci", "cj", r((F.col("s") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1), 2).alias("v"))


@query("moving_covariances", HOURLY + """, u AS (SELECT unnest([10, 100, 300]) AS u) SELECT CAST(u AS BIGINT) AS at, a.channel AS ci, b.channel AS cj, round(sum(a.x * b.x) / 60, 2) + 0.0 AS v FROM u JOIN sig a ON a.t > u - 60 AND a.t <= u JOIN sig b ON a.t = b.t GROUP BY 1, 2, 3""")
def _(spark, d):
    cut = windows.in_windows(S.hourly(spark, d).withColumn("t", F.col("t") + 60), [11, 101, 301], 60)
    return moments.pair_products(cut, ["start"]).select((F.col("start") - 1).alias("at"), "ci", "cj", r(F.col("s") / 60, 2).alias("v"))


@query("median_block_covariance", HOURLY + """, bl AS (SELECT CAST(floor(a.t / 100) AS BIGINT) AS block, a.channel AS ci, b.channel AS cj, sum(a.x * b.x) / 100 AS v FROM sig a JOIN sig b USING (t) GROUP BY 1, 2, 3)
SELECT ci, cj, round(median(v), 2) + 0.0 AS med, round(avg(v), 2) + 0.0 AS mean FROM bl GROUP BY 1, 2""")
def _(spark, d):
    sig = S.hourly(spark, d)
    b = moments.block_covariances(sig, 100, hours(sig), padded=False)
    return b.groupBy("ci", "cj").agg(r(F.median("v"), 2).alias("med"), r(F.avg("v"), 2).alias("mean"))


@query("robust_scale", HOURLY + ", c AS (SELECT channel, median(x) AS m FROM sig GROUP BY 1) SELECT channel, round(any_value(m), 4) + 0.0 AS center, round(CASE WHEN median(abs(x - m)) > 0 THEN 1.4826 * median(abs(x - m)) ELSE stddev_samp(x) END, 4) + 0.0 AS scale FROM sig JOIN c USING (channel) GROUP BY 1")
def _(spark, d):
    return shown(moments.robust_scale(S.hourly(spark, d)), "channel")


@query("automatic_mask", HOURLY + ", c AS (SELECT channel, median(x) AS m FROM sig GROUP BY 1), s AS (SELECT channel, any_value(m) AS m, CASE WHEN median(abs(x - m)) > 0 THEN 1.4826 * median(abs(x - m)) ELSE stddev_samp(x) END AS s FROM sig JOIN c USING (channel) GROUP BY 1) SELECT t, max(abs(x - m) / s) <= 4 AS \"on\" FROM sig JOIN s USING (channel) GROUP BY 1")
def _(spark, d):
    return moments.automatic_mask(S.hourly(spark, d), 4.0)


@query("histogram_mode", HOURLY + """, q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b, count(x) AS n, min(x) AS lo, max(x) AS hi FROM sig),
w AS (SELECT *, CASE WHEN b > a THEN greatest(1, ceil((hi - lo) / (2 * (b - a) / pow(n, 1.0 / 3)))) ELSE 1 END AS bins FROM q), h AS (SELECT least(floor((x - lo) / (hi - lo) * bins), bins - 1) AS bin, count(*) AS c FROM sig CROSS JOIN w GROUP BY 1)
SELECT round(lo + (bin + 0.5) * (hi - lo) / bins, 5) + 0.0 AS mode FROM h CROSS JOIN w ORDER BY c DESC, bin LIMIT 1""")
def _(spark, d):
    return spark.createDataFrame([(round(float(moments.histogram_mode(S.hourly(spark, d), "x")), 5),)], "mode double")


@query("histogram", HOURLY + ", e AS (SELECT channel, min(x) AS lo, max(x) AS hi FROM sig GROUP BY 1) SELECT channel, CAST(least(floor((x - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM sig JOIN e USING (channel) GROUP BY 1, 2")
def _(spark, d):
    return views.histogram(S.hourly(spark, d), 10)


@query("rereferenced", HOURLY + " SELECT channel, t, round(x - avg(x) OVER (PARTITION BY t), 4) + 0.0 AS x FROM sig")
def _(spark, d):
    return shown(references.rereferenced(S.hourly(spark, d)), "channel", "t")


@query("rereferenced_full_rank", HOURLY + " SELECT channel, t, round(x - sum(x) OVER (PARTITION BY t) / (count(*) OVER (PARTITION BY t) + 1), 4) + 0.0 AS x FROM sig")
def _(spark, d):
    return shown(references.rereferenced(S.hourly(spark, d), True), "channel", "t")


@query("spatial_transform", HOURLY + """, o AS (SELECT channel, row_number() OVER (ORDER BY channel) AS k FROM (SELECT DISTINCT channel FROM sig)) SELECT a.channel, s.t, round(sum(s.x / (1 + abs(a.k - b.k))), 4) + 0.0 AS x
FROM o a CROSS JOIN o b JOIN sig s ON s.channel = b.channel GROUP BY 1, 2""")
def _(spark, d):
    sig = S.hourly(spark, d)
    k = np.arange(len(S.channels_of(sig)))
    return shown(apply_long(sig, 1 / (1 + np.abs(k[:, None] - k[None]))), "channel", "t")


@query("transformed_covariance", HOURLY + """, dd AS (SELECT channel, t, x - lag(x) OVER (PARTITION BY t ORDER BY channel) AS y FROM sig), k AS (SELECT * FROM dd WHERE y IS NOT NULL)
SELECT a.channel AS "row", b.channel AS col, round(avg(a.y * b.y) - avg(a.y) * avg(b.y), 2) + 0.0 AS v FROM k a JOIN k b USING (t) GROUP BY 1, 2""")
def _(spark, d):
    sig = S.hourly(spark, d)
    names, (cov, _, _) = S.channels_of(sig), fitted_covariance(sig)
    m = (np.eye(len(names)) - np.eye(len(names), k=-1))[1:]
    return shown(matrix_table(sig, m @ cov @ m.T, names[1:], names[1:]), "row", "col", digits=2)


# --- spectra and quality -------------------------------------------------------------------------------------

@query("periodogram", PSD + " SELECT channel, round(freq, 6) + 0.0 AS freq, round(pb, 3) + 0.0 AS power FROM p")
def _(spark, d):
    return psd_pair(spark, d)[0].select("channel", r("freq", 6).alias("freq"), r("power", 3).alias("power"))


NEAREST = """bins AS (SELECT DISTINCT CAST(round(f * n / 24.0) AS BIGINT) AS k FROM nn CROSS JOIN (SELECT unnest([1, 2]) AS f))"""


@query("line_band_part", HOURLY + f""", {NEAREST}, z AS (SELECT channel, k, sum(x * cos(2 * pi() * ((k * t) % n) / n)) AS re, -sum(x * sin(2 * pi() * ((k * t) % n) / n)) AS im FROM sig CROSS JOIN bins CROSS JOIN nn GROUP BY 1, 2)
SELECT channel, t, round(sum(2 * (re * cos(2 * pi() * ((k * t) % n) / n) - im * sin(2 * pi() * ((k * t) % n) / n)) / n), 3) + 0.0 AS x FROM sig JOIN z USING (channel) CROSS JOIN nn GROUP BY 1, 2""")
def _(spark, d):
    sig = S.hourly(spark, d)
    n = hours(sig)
    return shown(spectral.band_part(sig, n, spectral.line_bins(n, 24.0, [1.0, 2.0], 1e-6)), "channel", "t", digits=3)


@query("line_band_bins", HOURLY + " SELECT CAST(k AS BIGINT) AS bin FROM nn CROSS JOIN (SELECT unnest(range(0, 100000)) AS k) WHERE k <= n // 2 AND (abs(k * 24.0 / n - 1) <= 0.11 OR abs(k * 24.0 / n - 2) <= 0.11)")
def _(spark, d):
    return spark.createDataFrame([(b,) for b in spectral.line_bins(hours(S.hourly(spark, d)), 24.0, [1.0, 2.0], 0.11)], "bin long")


@query("peak_attenuation_db", PSD + " SELECT channel, round(10 * log10(max(pb) / max(pa)), 4) + 0.0 AS db FROM p WHERE freq BETWEEN 0.89 AND 1.11 GROUP BY 1")
def _(spark, d):
    return shown(qa.peak_attenuation(*psd_pair(spark, d), 1.0, 0.11), "channel")


@query("suppression_ratio", PSD + " SELECT round(10 * log10(avg(pb) / avg(pa)), 4) + 0.0 AS db FROM p WHERE freq BETWEEN 0.89 AND 1.11")
def _(spark, d):
    return shown(qa.suppression_ratio(*psd_pair(spark, d), 1.0, 0.11))


@query("noise_surround_ratio", PSD + " SELECT channel, round(avg(CASE WHEN freq BETWEEN 0.89 AND 1.11 THEN pb END) / avg(CASE WHEN freq BETWEEN 0.49 AND 1.51 AND NOT freq BETWEEN 0.89 AND 1.11 THEN pb END), 4) + 0.0 AS ratio FROM p GROUP BY 1")
def _(spark, d):
    return shown(qa.noise_surround(psd_pair(spark, d)[0], 1.0, 0.11, 0.51), "channel")


@query("below_noise_distortion_db", PSD + " SELECT round(10 * avg(abs(log10(pa / pb))), 4) + 0.0 AS db FROM p WHERE freq BETWEEN 0.45 AND 6.01 AND NOT freq BETWEEN 0.75 AND 1.25 AND NOT freq BETWEEN 1.75 AND 2.25")
def _(spark, d):
    return shown(qa.below_noise_distortion(*psd_pair(spark, d), 1.0, 0.25, 0.45, 6.01, 1))


@query("spectral_distortion", PSD + " SELECT round(sqrt(avg(pow(10 * log10(pa / pb), 2))), 4) + 0.0 AS db FROM p WHERE freq BETWEEN 0.45 AND 6.01 AND NOT freq BETWEEN 0.85 AND 1.15 AND NOT freq BETWEEN 1.85 AND 2.15")
def _(spark, d):
    return shown(qa.spectral_distortion(*psd_pair(spark, d), 1.0, 2, 0.075, 0.45, 6.01))


@query("overclean_proportion", PSD + ", c AS (SELECT channel, 10 * log10(avg(pb) / avg(pa)) AS db FROM p WHERE freq BETWEEN 0.67 AND 1.33 AND NOT freq BETWEEN 0.89 AND 1.11 GROUP BY 1) SELECT round(avg(CASE WHEN db > 3 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS share FROM c")
def _(spark, d):
    return shown(qa.overclean(*psd_pair(spark, d), 1.0, 0.11))


@query("underclean_proportion", PSD + ", c AS (SELECT channel, avg(CASE WHEN freq BETWEEN 0.89 AND 1.11 THEN pa END) / avg(CASE WHEN freq BETWEEN 0.49 AND 1.51 AND NOT freq BETWEEN 0.89 AND 1.11 THEN pa END) AS ratio FROM p GROUP BY 1) SELECT round(avg(CASE WHEN ratio > 1 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS share FROM c")
def _(spark, d):
    return shown(qa.underclean(psd_pair(spark, d)[1], 1.0, 0.11, 0.51, 1.0))


@query("geometric_mean_psd_ratio", PSD + " SELECT round(exp(avg(ln(pa / pb))), 5) + 0.0 AS ratio FROM p WHERE freq BETWEEN 0.45 AND 6.01")
def _(spark, d):
    return shown(qa.geometric_ratio(*psd_pair(spark, d), 0.45, 6.01), digits=5)


@query("variance_removed", SMOOTH + " SELECT round(100 * (1 - var_pop(x - y) / var_pop(x)), 4) + 0.0 AS percent FROM sm")
def _(spark, d):
    return shown(qa.variance_removed(*smooth_pair(spark, d)))


@query("rms_change", SMOOTH + " SELECT round(sqrt(avg(y * y)), 4) + 0.0 AS rms FROM sm")
def _(spark, d):
    return shown(qa.rms_change(*smooth_pair(spark, d)))


@query("max_abs_change", SMOOTH + " SELECT round(max(abs(y)), 4) + 0.0 AS change FROM sm")
def _(spark, d):
    return shown(qa.max_change(*smooth_pair(spark, d)))


@query("quality_summary", PSD + """, v AS (SELECT channel, var_pop(x - y) / var_pop(x) AS ratio FROM sm GROUP BY 1), a AS (SELECT channel, 10 * log10(max(pb) / max(pa)) AS db FROM p WHERE freq BETWEEN 0.89 AND 1.11 GROUP BY 1),
s AS (SELECT channel, avg(CASE WHEN freq BETWEEN 0.89 AND 1.11 THEN pa END) / avg(CASE WHEN freq BETWEEN 0.725 AND 1.275 AND NOT freq BETWEEN 0.89 AND 1.11 THEN pa END) AS ratio FROM p GROUP BY 1)
SELECT 'variance_removed' AS metric, round(100 * (1 - var_pop(x - y) / var_pop(x)), 4) + 0.0 AS value FROM sm UNION ALL SELECT 'rms_change', round(sqrt(avg(y * y)), 4) + 0.0 FROM sm UNION ALL SELECT 'max_change', round(max(abs(y)), 4) + 0.0 FROM sm
UNION ALL SELECT 'variance_ratio', round(median(ratio), 4) + 0.0 FROM v UNION ALL SELECT 'geometric_ratio', round(exp(avg(ln(pa / pb))), 4) + 0.0 FROM p UNION ALL SELECT 'attenuation_1', round(median(db), 4) + 0.0 FROM a UNION ALL SELECT 'surround_1', round(median(ratio), 4) + 0.0 FROM s""")
def _(spark, d):
    return shown(qa.summary(*smooth_pair(spark, d), *psd_pair(spark, d), 1.0, 0, 0.11), "metric")


@query("log_power", PSD + ", f AS (SELECT max(pb) * 1e-20 AS f FROM p) SELECT round(freq, 6) + 0.0 AS freq, round(avg(10 * log10(greatest(pb, f))), 4) + 0.0 AS db FROM p CROSS JOIN f GROUP BY 1")
def _(spark, d):
    return spectral.log_power(psd_pair(spark, d)[0]).select(r("freq", 6).alias("freq"), r("db").alias("db"))


LOGS = PSD + ", lg AS (SELECT k, freq, avg(10 * log10(pb)) AS db FROM p GROUP BY 1, 2)"


@query("noise_frequencies", LOGS + """, m AS (SELECT a.k, a.db AS peak, any_value(a.freq) AS freq, avg(CASE WHEN abs(a.freq - b.freq) > 3.0001 / 6 THEN b.db END) AS around, max(b.db) AS top FROM lg a JOIN lg b ON abs(a.freq - b.freq) <= 3.0001 / 2 WHERE a.freq BETWEEN 0.399 AND 11.201 GROUP BY 1, 2)
SELECT round(freq, 6) + 0.0 AS freq, round(peak, 4) + 0.0 AS db, round(around, 4) + 0.0 AS around FROM m WHERE peak = top AND peak > around + 2""")
def _(spark, d):
    found = spectral.noise_frequencies(spectral.log_power(psd_pair(spark, d)[0]), 0.399, 11.201, 3.0001, 2.0)
    return found.select(r("freq", 6).alias("freq"), r("db").alias("db"), r("around").alias("around"))


@query("component_slopes", PSD + " SELECT channel, round(regr_slope(log10(pb), log10(freq)), 5) + 0.0 AS slope FROM p WHERE freq BETWEEN 0.45 AND 6.01 GROUP BY 1")
def _(spark, d):
    return shown(spectral.slopes(psd_pair(spark, d)[0], 0.45, 6.01), "channel", digits=5)


@query("overcorrection", """WITH lf AS (SELECT vec_id AS source, CAST(unnest(embedding) AS DOUBLE) AS gain FROM embeddings), nw AS (SELECT source, gain, gain - avg(gain) OVER (PARTITION BY source) AS nw FROM lf)
SELECT source, round(sqrt(sum(nw * nw)) / sqrt(sum(gain * gain)) - 1, 5) + 0.0 AS amplitude_change, round(corr(gain, nw), 5) + 0.0 AS correlation, round(sqrt(sum(pow(gain - nw, 2))) / sqrt(sum(gain * gain)), 5) + 0.0 AS relative_error, round(1 - sum(pow(gain - nw, 2)) / sum(gain * gain), 5) + 0.0 AS goodness FROM nw GROUP BY 1""")
def _(spark, d):
    """What referring to the mean does to each vector, taken as a topography."""
    sig = S.vectors(spark, d)
    names, c = S.channels_of(sig), len(S.channels_of(sig))
    lead = sig.select("channel", F.col("t").alias("source"), F.col("x").alias("gain"))
    return shown(qa.overcorrection(matrix_table(lead, np.eye(c) - 1 / c, names, names), lead), "source", digits=5)


@query("spherical_points", "SELECT s_suppkey AS k, round(1 - 2 * (s_suppkey + 0.5) / n, 6) + 0.0 AS z, round(sqrt(1 - pow(1 - 2 * (s_suppkey + 0.5) / n, 2)) * cos(pi() * (1 + sqrt(5)) * (s_suppkey + 0.5)), 6) + 0.0 AS x FROM supplier CROSS JOIN (SELECT max(s_suppkey) + 1 AS n FROM supplier)")
def _(spark, d):
    """A place on the sphere for each supplier, by its key."""
    suppliers = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return shown(head.on_sphere(suppliers, F.col("k"), (suppliers.agg(F.max("k")).first()[0] or 0) + 1).select("k", "z", "x"), "k", digits=6)


# --- data behind views ---------------------------------------------------------------------------------------

@query("global_field_power", HOURLY + " SELECT k AS t, round(sqrt(avg(m * m)), 4) + 0.0 AS gfp FROM (SELECT channel, t % 24 AS k, avg(x) AS m FROM sig CROSS JOIN nn WHERE t < floor(n / 24) * 24 GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    return shown(views.field_power(S.to_epochs(S.hourly(spark, d), DAY)), "t")


@query("grand_average", HOURLY + " SELECT channel, t % 24 AS t, round(avg(x), 4) + 0.0 AS mean, round(stddev_samp(x) / sqrt(count(*)), 4) + 0.0 AS sem FROM sig CROSS JOIN nn WHERE t < floor(n / 24) * 24 GROUP BY 1, 2")
def _(spark, d):
    return shown(views.grand_average(S.to_epochs(S.hourly(spark, d), DAY)), "channel", "t")


METRICS = "WITH m AS (SELECT doc_id AS subject, lang AS grp, CAST(n_chars AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces FROM documents)"


def metric_table(spark, d):
    text = F.col("text")
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("subject"), F.col("lang").alias("grp"), (F.col("n_chars") * 1.0).alias("chars"), (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 0.0).alias("spaces"))


@query("metric_bars", METRICS + " SELECT grp, round(avg(chars), 4) + 0.0 AS mean, round(stddev_samp(chars) / sqrt(count(chars)), 4) + 0.0 AS sem, count(chars) AS n FROM m GROUP BY 1")
def _(spark, d):
    return shown(views.metric_bars(metric_table(spark, d), "chars", "grp"), "grp", "n")


@query("metric_violins", METRICS + " SELECT grp, round(quantile_cont(chars, 0.05), 3) + 0.0 AS p5, round(quantile_cont(chars, 0.25), 3) + 0.0 AS p25, round(median(chars), 3) + 0.0 AS p50, round(quantile_cont(chars, 0.75), 3) + 0.0 AS p75, round(quantile_cont(chars, 0.95), 3) + 0.0 AS p95 FROM m GROUP BY 1")
def _(spark, d):
    return shown(views.metric_violins(metric_table(spark, d), "chars", "grp"), "grp", digits=3)


@query("tradeoff_scatter", METRICS + " SELECT grp, subject, round(chars, 3) + 0.0 AS x, round(spaces, 3) + 0.0 AS y FROM m")
def _(spark, d):
    return shown(views.tradeoff(metric_table(spark, d), "chars", "spaces", "grp"), "grp", "subject", digits=3)


@query("forest", METRICS + " SELECT grp, round(avg(chars), 3) + 0.0 AS mean, round(avg(chars) - 1.96 * stddev_samp(chars) / sqrt(count(chars)), 3) + 0.0 AS low, round(avg(chars) + 1.96 * stddev_samp(chars) / sqrt(count(chars)), 3) + 0.0 AS high FROM m GROUP BY 1")
def _(spark, d):
    return shown(views.forest(metric_table(spark, d), "chars", "grp"), "grp", digits=3)


@query("paired_slopes", """SELECT o_orderpriority AS subject, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) + 0.0 AS a, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) + 0.0 AS b,
round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) - avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) + 0.0 AS change FROM orders GROUP BY 1""")
def _(spark, d):
    o = S.table(spark, d, "orders").select(F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("grp"), F.col("o_totalprice").alias("value"))
    return shown(views.paired_slopes(o, "value", "F", "O"), "subject", digits=2)


@query("null_distribution", "SELECT round(quantile_cont(l_quantity, 0.025), 4) + 0.0 AS low, round(quantile_cont(l_quantity, 0.975), 4) + 0.0 AS high, round(avg(CASE WHEN abs(l_quantity) >= 40 THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS p FROM lineitem")
def _(spark, d):
    return shown(views.null_distribution(S.table(spark, d, "lineitem").select(F.col("l_quantity").alias("value")), 40.0), digits=5)


@query("condition_interaction", """SELECT l_returnflag AS condition, l_linestatus AS grp, CAST(l_linenumber AS BIGINT) AS t, round(avg(l_quantity), 4) + 0.0 AS mean, round(stddev_samp(l_quantity) / sqrt(count(*)), 4) + 0.0 AS sem FROM lineitem GROUP BY 1, 2, 3""")
def _(spark, d):
    li = S.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("grp"), F.col("l_linenumber").cast("long").alias("t"), F.col("l_quantity").alias("x"))
    return shown(views.interaction(li), "condition", "grp", "t")


@query("power_ratio_map", SMOOTH + " SELECT channel, round(var_pop(x - y) / nullif(var_pop(x), 0), 4) + 0.0 AS ratio FROM sm GROUP BY 1")
def _(spark, d):
    return shown(views.power_ratio(*smooth_pair(spark, d)), "channel")


@query("signal_overlay", SMOOTH + ", s AS (SELECT channel, stddev_pop(x) / stddev_pop(x - y) AS f FROM sm GROUP BY 1) SELECT channel, t, round(x, 4) + 0.0 AS before, round((x - y) * f, 3) + 0.0 AS after FROM sm JOIN s USING (channel) WHERE t BETWEEN 100 AND 199")
def _(spark, d):
    out = views.overlay(*smooth_pair(spark, d), 100, 200)
    return out.select("channel", "t", r("before").alias("before"), r("after", 3).alias("after"))


@query("time_course", SMOOTH + " SELECT channel, t, round(x + 0.00001234567, 4) + 0.0 AS before, round(x - y + 0.00001234567, 4) + 0.0 AS after FROM sm WHERE t BETWEEN 100 AND 199 AND channel IN ('click', 'view')")
def _(spark, d):
    return shown(views.time_course(*smooth_pair(spark, d), ["click", "view"], 100, 200), "channel", "t", nudge=OFF)


@query("mean_psd_comparison", PSD + " SELECT round(freq, 6) + 0.0 AS freq, round(avg(pb), 3) + 0.0 AS before, round(avg(pa), 3) + 0.0 AS after FROM p GROUP BY 1")
def _(spark, d):
    out = views.psd_comparison(*psd_pair(spark, d))
    return out.select(r("freq", 6).alias("freq"), r("before", 3).alias("before"), r("after", 3).alias("after"))


@query("psd_zoom", PSD + " SELECT channel, round(freq, 6) + 0.0 AS freq, round(10 * log10(pb), 4) + 0.0 AS before, round(10 * log10(pa), 4) + 0.0 AS after FROM p WHERE freq BETWEEN 0.55 AND 1.45")
def _(spark, d):
    out = views.psd_zoom(*psd_pair(spark, d), 1.0, 0.45)
    return out.select("channel", r("freq", 6).alias("freq"), r("before").alias("before"), r("after").alias("after"))


@query("harmonic_attenuation", PSD + " SELECT CAST(h AS BIGINT) AS harmonic, channel, round(10 * log10(max(pb) / max(pa)), 4) + 0.0 AS db FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS h) WHERE freq BETWEEN h - 0.11 AND h + 0.11 GROUP BY 1, 2")
def _(spark, d):
    return shown(views.harmonic_attenuation(*psd_pair(spark, d), 1.0, 3, 0.11), "harmonic", "channel")


# --- estimators (no SQL) -------------------------------------------------------------------------------------

def _trend(spark, d):
    return S.hourly(spark, d)


@query("dss_smooth")
def _(spark, d):
    sig = _trend(spark, d)
    return dss.smooth(sig, DAY).table(sig)


@query("dss_epochs_sources")
def _(spark, d):
    sig = S.hourly(spark, d)
    flat = S.to_epochs(sig, DAY)
    return dss.epochs(flat).sources(sig)


@query("dss_denoised")
def _(spark, d):
    sig = _trend(spark, d)
    return dss.denoised(sig, dss.smooth(sig, DAY), 2)


@query("dss_segmented")
def _(spark, d):
    sig = _trend(spark, d)
    return dss.segmented(sig, hours(sig), 240, 12, lambda s: windows.running_mean(s, DAY), 1)


@query("dss_narrowband")
def _(spark, d):
    sig = _trend(spark, d)
    return dss.narrowband(sig, 24.0, 1.0, 0.4).table(sig)


@query("dss_narrowband_scan")
def _(spark, d):
    return spark.createDataFrame(dss.narrowband_scan(_trend(spark, d), 24.0, [0.5, 1.0, 2.0, 4.0], 0.4), "freq double, score double, error string")


@query("dss_comb")
def _(spark, d):
    sig = _trend(spark, d)
    return dss.comb(sig, 24.0, 1.0).table(sig)


@query("dss_time_shift")
def _(spark, d):
    ep = S.to_epochs(S.hourly(spark, d), DAY)
    model, wide = dss.time_shifted(ep, [0, 1, 2], 8, 2)
    return model.table(wide)


@query("evoked_share", HOURLY + """, e AS (SELECT channel, t % 24 AS k, x FROM sig CROSS JOIN nn WHERE t < floor(n / 24) * 24), m AS (SELECT channel, avg(m * m) AS ev FROM (SELECT channel, k, avg(x) AS m FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT channel, round(any_value(ev) / avg(x * x), 5) + 0.0 AS score FROM e JOIN m USING (channel) GROUP BY 1""")
def _(spark, d):
    return shown(dss.evoked_share(S.to_epochs(S.hourly(spark, d), DAY)), "channel", digits=5)


@query("dss_iterative")
def _(spark, d):
    sig = S.vectors(spark, d)
    model, _ = dss.iterative(sig, 2, rounds=60, tol=1e-4, rank=8)
    return model.table(sig)


@query("dss_iterative_symmetric")
def _(spark, d):
    sig = S.vectors(spark, d)
    model, _ = dss.iterative(sig, 2, "pow3", symmetric=True, rounds=60, tol=1e-4, rank=8)
    return model.table(sig)


@query("component_counts", """WITH s AS (SELECT sum(l_extendedprice) AS v FROM lineitem GROUP BY l_discount, l_returnflag, l_linestatus), r AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS k, max(v) OVER () AS top, count(*) OVER () AS n FROM s),
d AS (SELECT k, n, CASE WHEN v > 0.01 * top THEN log10(v) - log10(lead(v) OVER (ORDER BY k)) END AS fall, k <= n // 2 AS half FROM r),
knee AS (SELECT coalesce(max(CASE WHEN fall >= log10(3) THEN k END), 0) AS n FROM (SELECT k, fall FROM d WHERE fall IS NOT NULL ORDER BY fall DESC, k LIMIT 1)),
near AS (SELECT coalesce(max(CASE WHEN fall >= log10(3) THEN k END), 0) AS n FROM (SELECT k, fall FROM d WHERE fall IS NOT NULL AND half ORDER BY fall DESC, k LIMIT 1)),
a AS (SELECT v FROM s WHERE v <= (SELECT avg(v) + 3 * stddev_pop(v) FROM s)), b AS (SELECT v FROM a WHERE v <= (SELECT avg(v) + 3 * stddev_pop(v) FROM a)), c AS (SELECT v FROM b WHERE v <= (SELECT avg(v) + 3 * stddev_pop(v) FROM b)),
o AS (SELECT (SELECT count(*) FROM s) - (SELECT count(*) FROM c) AS n)
SELECT 'knee' AS rule, CAST(n AS BIGINT) AS n FROM knee UNION ALL SELECT 'outliers', n FROM o UNION ALL SELECT 'both', greatest((SELECT n FROM o), (SELECT n FROM near))""")
def _(spark, d):
    """How many of the sales by discount, return flag and status stand out."""
    sales = S.table(spark, d, "lineitem").groupBy("l_discount", "l_returnflag", "l_linestatus").agg(F.sum("l_extendedprice").cast("double").alias("v"))
    s = sorted((row.v for row in sales.collect()), reverse=True)
    return spark.createDataFrame([("knee", L.knee(s)), ("outliers", L.outliers(s)), ("both", L.component_count(s))], "rule string, n long")


@query("covariance_segments")
def _(spark, d):
    sig = _trend(spark, d)
    return spark.createDataFrame(dss.covariance_boundaries(sig, hours(sig), 24, 96), "start long, stop long")


@query("line_clean")
def _(spark, d):
    sig = _trend(spark, d)
    return lines.clean(sig, 24.0, 1.0, hours(sig), 1)[0]


@query("line_clean_band_only")
def _(spark, d):
    sig = _trend(spark, d)
    return lines.clean(sig, 24.0, 1.0, hours(sig), 1, width=0.05)[0]


@query("line_clean_adaptive")
def _(spark, d):
    sig = _trend(spark, d)
    return lines.clean_adaptive(sig, 24.0, hours(sig), 0.5, 10.0, 20.0)[0]


@query("line_smooth_fractional")
def _(spark, d):
    return lines.period_smooth(_trend(spark, d), 24.0, 0.7)


@query("line_blocks")
def _(spark, d):
    sig = _trend(spark, d)
    return spectral.line_blocks(sig, 1.0, 24.0, hours(sig), 240, 0.05)


@query("line_presence")
def _(spark, d):
    sig = _trend(spark, d)
    return spectral.line_present(spectral.log_power(spectral.welch(sig, 24.0, 240)), 1.0, 0.06)


@query("line_verdict")
def _(spark, d):
    sig = _trend(spark, d)
    return spectral.line_verdict(spectral.log_power(spectral.welch(sig, 24.0, 480)), 3.5)


@query("line_harmonics")
def _(spark, d):
    sig = _trend(spark, d)
    return spectral.harmonics(spectral.log_power(spectral.welch(sig, 24.0, 240)), 1.0, 12.0, 1.0, 0.5)


@query("bandpass")
def _(spark, d):
    return spectral.bandpass(_trend(spark, d), 24.0, 0.8, 1.2)


@query("peak_filter")
def _(spark, d):
    return spectral.peak(_trend(spark, d), 24.0, 1.0)


@query("comb_filter")
def _(spark, d):
    return spectral.comb(_trend(spark, d), 24.0, 1.0, 3, proportional=True)


@query("notch")
def _(spark, d):
    return spectral.notch(_trend(spark, d), 24.0, 1.0, 0.1)


@query("hybrid_notch")
def _(spark, d):
    return spectral.hybrid_notch(_trend(spark, d), 24.0, 3.5, 0.1)


@query("spectrum_interpolation", HOURLY + """, lines AS (SELECT unnest([1.0, 2.0]) AS f), bins AS (SELECT f, k, abs(k * 24.0 / n - f) <= 0.05001 AS band FROM lines CROSS JOIN nn CROSS JOIN (SELECT unnest(range(1, (SELECT CAST(n // 2 AS BIGINT) FROM nn))) AS k) WHERE abs(k * 24.0 / n - f) <= 0.25001),
z AS (SELECT channel, f, k, band, sum(x * cos(2 * pi() * ((k * t) % n) / n)) AS re, -sum(x * sin(2 * pi() * ((k * t) % n) / n)) AS im FROM sig CROSS JOIN bins CROSS JOIN nn GROUP BY 1, 2, 3, 4),
w AS (SELECT channel, k, re, im, m / sqrt(re * re + im * im) - 1 AS more FROM z JOIN (SELECT channel, f, avg(sqrt(re * re + im * im)) AS m FROM z WHERE NOT band GROUP BY 1, 2) r USING (channel, f) WHERE band)
SELECT s.channel, s.t, round(any_value(s.x) + sum(2.0 / n * more * (re * cos(2 * pi() * ((k * t) % n) / n) - im * sin(2 * pi() * ((k * t) % n) / n))), 4) + 0.0 AS x FROM sig s JOIN w ON w.channel = s.channel CROSS JOIN nn GROUP BY 1, 2""")
def _(spark, d):
    trend = _trend(spark, d)
    return shown(transforms.interpolate_lines(trend, hours(trend), 24.0, [1.0, 2.0], 0.05001, 0.2), "channel", "t")


@query("welch_psd", HOURLY + """, g2 AS (SELECT unnest(range(0, (SELECT n - 95 FROM nn), 48)) AS lo), seg AS (SELECT channel, lo, t - lo AS i, x - avg(x) OVER (PARTITION BY channel, lo) AS x FROM sig JOIN g2 ON t >= lo AND t < lo + 96),
h AS (SELECT channel, lo, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 96)) AS x FROM seg), z AS (SELECT channel, lo, k, sum(x * cos(2 * pi() * ((k * i) % 96) / 96)) AS re, sum(x * sin(2 * pi() * ((k * i) % 96) / 96)) AS im FROM h CROSS JOIN (SELECT unnest(range(49)) AS k) GROUP BY 1, 2, 3)
SELECT channel, k / 4.0 AS freq, round(avg((re * re + im * im) * CASE WHEN k IN (0, 48) THEN 1 ELSE 2 END / (24 * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * j / 96), 2)) FROM (SELECT unnest(range(96)) AS j)))), 4) + 0.0 AS power FROM z GROUP BY 1, 2""")
def _(spark, d):
    return shown(spectral.welch(_trend(spark, d), 24.0, 96), "channel", "freq")


@query("cosine_mask", HOURLY + """, ks AS (SELECT unnest(range(greatest(1, CAST(floor(0.2 * (SELECT n FROM nn)) AS BIGINT)))) AS k),
c AS (SELECT channel, k, sum(x * cos(pi() * (t + 0.5) * k / n)) AS c FROM sig CROSS JOIN ks CROSS JOIN nn GROUP BY 1, 2)
SELECT s.channel, s.t, round(sum(CASE WHEN k = 0 THEN c / n ELSE 2 * c / n * cos(pi() * (s.t + 0.5) * k / n) END), 4) + 0.0 AS x FROM sig s JOIN c ON c.channel = s.channel CROSS JOIN nn GROUP BY 1, 2""")
def _(spark, d):
    trend = _trend(spark, d)
    return shown(transforms.cosine_mask(trend, hours(trend), 0.2), "channel", "t")


@query("spectrogram_mask")
def _(spark, d):
    return series.spectrogram_mask(_trend(spark, d), 48)


@query("quasi_periodic")
def _(spark, d):
    return series.quasi_periodic(_trend(spark, d), 12)


@query("rms_distribution")
def _(spark, d):
    sig = _trend(spark, d)
    return series.rms_distribution(windows.window_rms(sig, windows.fractional_starts(hours(sig), 24, 0.5), 24))


@query("clean_windows")
def _(spark, d):
    sig = _trend(spark, d)
    return asr.clean_windows(sig, 24.0, hours(sig))[0]


def _calibrated(spark, d):
    sig = _trend(spark, d)
    n = hours(sig)
    return sig, n, asr.calibrate(sig, 24.0, n, 3.0, length=1.0)


@query("asr")
def _(spark, d):
    sig, n, state = _calibrated(spark, d)
    return asr.process(sig, state, 24.0, n, 1.0, chunk=240)


@query("asr_guided_weights")
def _(spark, d):
    """How much of each direction every update of the guided repair keeps."""
    sig, n, state = _calibrated(spark, d)
    weights = asr.guided_weights(None, asr.guidance(sig, [windows.running_mean(sig, DAY)]))
    return views.guided_weights(asr.process(sig, state, 24.0, n, 1.0, chunk=240, weights=weights, log=True))


@query("asr_guided")
def _(spark, d):
    sig, n, state = _calibrated(spark, d)
    keep = asr.guidance(sig, [windows.running_mean(sig, DAY)])
    return asr.process(sig, state, 24.0, n, 1.0, chunk=240, weights=asr.guided_weights(None, keep))


@query("asr_reference_samples")
def _(spark, d):
    return asr.reference_samples(_trend(spark, d), 3)


@query("density_clusters", HOURLY.replace("WITH", "WITH RECURSIVE", 1) + """, f AS (SELECT t, list_sort(list(abs(x)), 'DESC') AS q FROM sig GROUP BY 1),
near AS (SELECT a.t AS a, b.t AS b FROM f a JOIN f b ON abs(a.q[1] - b.q[1]) <= 20.0007 AND abs(a.q[2] - b.q[2]) <= 20.0007), core AS (SELECT a AS t FROM near GROUP BY 1 HAVING count(*) >= 8),
link AS (SELECT a, b FROM near WHERE a IN (SELECT t FROM core) AND b IN (SELECT t FROM core)), reach AS (SELECT t AS root, t FROM core UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.t),
label AS (SELECT t, min(root) AS cluster FROM reach GROUP BY 1), border AS (SELECT n.a AS t, min(l.cluster) AS cluster FROM near n JOIN label l ON l.t = n.b WHERE n.a NOT IN (SELECT t FROM core) GROUP BY 1)
SELECT f.t, coalesce(label.cluster, border.cluster, -1) AS cluster, label.t IS NOT NULL AS core FROM f LEFT JOIN label ON label.t = f.t LEFT JOIN border ON border.t = f.t""")
def _(spark, d):
    tops = S.by_sample(_trend(spark, d)).select("t", F.slice(F.sort_array(F.transform("xs", lambda v: F.abs(v)), asc=False), 1, 2).alias("f"))
    return density.clusters(tops, 20.0007, 8, 2).select("t", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"), "core")


@query("asr_reference_samples_gev")
def _(spark, d):
    return asr.gev_reference(_trend(spark, d))


@query("asr_stream")
def _(spark, d):
    """The repair of ``asr``, of a stream in five uneven chunks."""
    sig, _, state = _calibrated(spark, d)
    return streams.repair(spark, sig, state, 24.0, 1.0)


@query("asr_adaptive_stream")
def _(spark, d):
    return streams.adaptive_repair(spark, d)


@query("running_mean_stream", SMOOTH + " SELECT channel, t, round(y + 0.00001234567, 4) + 0.0 AS x FROM sm")
def _(spark, d):
    return shown(streams.running_mean_stream(spark, d, DAY), "channel", "t", nudge=OFF)


@query("delayed_cca")
def _(spark, d):
    sig = _trend(spark, d)
    model, gone = references.delayed_cca(sig, 1, remove=1)
    return model.remove(sig, gone)


@query("delayed_cca_blocks")
def _(spark, d):
    sig = _trend(spark, d)
    return references.delayed_cca_blocks(sig, hours(sig), 240, 160, 1, remove=1)[0]


@query("delayed_cca_block_components")
def _(spark, d):
    sig = _trend(spark, d)
    return references.delayed_cca_blocks(sig, hours(sig), 240, 160, 1, threshold=0.5)[1]


@query("reference_clean")
def _(spark, d):
    sig = _trend(spark, d)
    return references.reference_clean(sig.where("channel <> 'error'"), sig.where("channel = 'error'"), 24.0, hours(sig), 4.0, 0.5, 0.05)


@query("reference_null_thresholds")
def _(spark, d):
    sig = _trend(spark, d)
    return references.null_thresholds(sig.where("channel <> 'error'"), sig.where("channel = 'error'"), 24.0, hours(sig), 4.0, 0.5)


@query("reference_clean_above_chance")
def _(spark, d):
    sig = _trend(spark, d)
    return references.reference_clean(sig.where("channel <> 'error'"), sig.where("channel = 'error'"), 24.0, hours(sig), 4.0, 0.5, null=0.05)


@query("sensor_noise_suppressed")
def _(spark, d):
    return references.suppress_sensor_noise(S.vectors(spark, d), 3)[0]


def _lead(n: int, m: int = 12) -> np.ndarray:
    return head.lead_field(L.spherical_points(n), m)[0]


@query("source_informed")
def _(spark, d):
    return references.source_informed(S.vectors(spark, d), _lead(64))[0]


@query("projected_recovery")
def _(spark, d):
    sig = S.vectors(spark, d)
    top = references.artifact_topographies(sig, 100.0, 20.0, 1)
    return references.projected_recovery(sig, _lead(64), top, 24)


@query("ssa")
def _(spark, d):
    return series.ssa(_trend(spark, d), 24.0, hours(_trend(spark, d)), 48, 0.1)


@query("ssa_groups")
def _(spark, d):
    sig = _trend(spark, d)
    return series.ssa_groups(sig, 24.0, hours(sig), 24)


@query("ssa_local")
def _(spark, d):
    return series.local_ssa(_trend(spark, d), 24.0, 24)


@query("trajectory", HOURLY + " SELECT a.channel, CAST(k AS BIGINT) AS k, a.t, round(b.x, 4) + 0.0 AS x FROM sig a CROSS JOIN (SELECT unnest(range(0, 4)) AS k) JOIN sig b ON b.channel = a.channel AND b.t = a.t + k CROSS JOIN nn WHERE a.t <= n - 4")
def _(spark, d):
    return shown(series.trajectory(S.hourly(spark, d), 4, block=100), "channel", "k", "t")


@query("diagonal_average", HOURLY + " SELECT channel, t, round(x, 3) + 0.0 AS x FROM sig")
def _(spark, d):
    return shown(series.diagonal_average(series.trajectory(S.hourly(spark, d), 4)), "channel", "t", digits=3)


@query("whitened")
def _(spark, d):
    sig = S.vectors(spark, d)
    cov, mean, _ = fitted_covariance(sig)
    w, _ = L.whitener(cov)
    return apply_long(sig, w, mean, [f"w{k}" for k in range(len(w))])


@query("mixing_least_squares")
def _(spark, d):
    sig = S.vectors(spark, d)
    names = S.channels_of(sig)
    cov, _, _ = fitted_covariance(sig)
    w, dw = L.whitener(cov)
    return matrix_table(sig, cov @ w.T @ np.linalg.pinv(w @ cov @ w.T), names, [f"s{k:03d}" for k in range(w.shape[0])])


@query("cca")
def _(spark, d):
    sig = S.vectors(spark, d)
    a, b, rho, _ = references.correlate(sig.where("channel < 'e3'"), sig.where("channel >= 'e3'"))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(rho)], "component int, r double")


@query("geometric_median_covariance")
def _(spark, d):
    sig = _trend(spark, d)
    names = S.channels_of(sig)
    return matrix_table(sig, asr._median_covariance(moments.block_covariances(sig, 24, hours(sig)), names), names, names)


@query("robust_covariance")
def _(spark, d):
    sig = S.vectors(spark, d)
    names = S.channels_of(sig)
    return matrix_table(sig, moments.robust_covariance(S.by_sample(sig))[1], names, names)


@query("gfp_bootstrap")
def _(spark, d):
    return views.field_power_bootstrap(S.to_epochs(S.hourly(spark, d), DAY), 200)




# --- more ----------------------------------------------------------------------------------------------------

@query("density", HOURLY + " SELECT channel, count(*) AS n, 1.0 AS finite, round(var_pop(x), 3) + 0.0 AS spread, true AS dense FROM sig GROUP BY 1")
def _(spark, d):
    found = validation.density(S.hourly(spark, d))
    return found.select("channel", "n", "finite", r("spread", 3).alias("spread"), "dense")


@query("lag_weights", HOURLY + " SELECT channel, t, round(least(x, lag(x, 1) OVER w, lag(x, 2) OVER w), 4) + 0.0 AS w FROM sig WINDOW w AS (PARTITION BY channel ORDER BY t) QUALIFY t >= 2")
def _(spark, d):
    return shown(windows.lag_weights(S.hourly(spark, d), [0, 1, 2], block=100), "channel", "t")


@query("daily_signal", """WITH g AS (SELECT o_orderpriority AS channel, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS h, sum(o_totalprice) / 1000 AS x FROM orders GROUP BY 1, 2), b AS (SELECT min(h) AS lo, max(h) AS hi FROM g)
SELECT c.channel, r.h - b.lo AS t, round(coalesce(g.x, 0.0) + 0.00001234567, 4) + 0.0 AS x FROM (SELECT DISTINCT channel FROM g) c CROSS JOIN b CROSS JOIN (SELECT unnest(range((SELECT lo FROM b), (SELECT hi + 1 FROM b))) AS h) r LEFT JOIN g ON g.channel = c.channel AND g.h = r.h""")
def _(spark, d):
    return shown(S.daily(spark, d), "channel", "t", nudge=OFF)


@query("vector_signal", "SELECT 'e' || (i - 1) AS channel, vec_id AS t, round(CAST(x AS DOUBLE), 6) + 0.0 AS x FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings)")
def _(spark, d):
    return shown(S.vectors(spark, d), "channel", "t", digits=6)


@query("spectrogram_view")
def _(spark, d):
    return views.spectrogram(S.hourly(spark, d), 24.0, 48)


@query("asr_on_reference_samples")
def _(spark, d):
    sig = S.hourly(spark, d)
    n = hours(sig)
    state = asr.calibrate(sig, 24.0, n, 3.0, length=1.0, reference=asr.reference_samples(sig, 3))
    return asr.process(sig, state, 24.0, n, 1.0, chunk=240)


@query("component_epochs_image", HOURLY + """, c AS (SELECT 'difference' AS component, a.t, a.x - b.x AS x FROM sig a JOIN sig b USING (t) WHERE a.channel = 'click' AND b.channel = 'view' UNION ALL SELECT 'total', t, sum(x) FROM sig GROUP BY t)
SELECT component, CAST(floor(t / 24) AS BIGINT) AS epoch, t % 24 AS t, round(x, 4) + 0.0 AS x FROM c CROSS JOIN nn WHERE t < floor(n / 24) * 24""")
def _(spark, d):
    sig = S.hourly(spark, d)
    names = S.channels_of(sig)
    m = np.array([[float(c == "click") - float(c == "view") for c in names], [1.0] * len(names)])
    return shown(views.epochs_image(apply_long(sig, m, None, ["difference", "total"]), DAY), "component", "epoch", "t")


@query("window_counts", HOURLY + """, m AS (SELECT channel, avg(x) AS m FROM sig GROUP BY 1), w AS (SELECT CAST(floor(t / 24) AS BIGINT) AS "window", CAST(sum(CASE WHEN x > m THEN 1 ELSE 0 END) AS BIGINT) AS n FROM sig JOIN m USING (channel) GROUP BY 1)
SELECT "window", n, round(avg(n) OVER (), 4) + 0.0 AS mean FROM w""")
def _(spark, d):
    sig = S.hourly(spark, d)
    mean = sig.groupBy("channel").agg(F.avg("x").alias("m"))
    return shown(views.count_series(sig.join(mean, "channel").select("t", (F.col("x") > F.col("m")).alias("on")), DAY), "window", "n")


@query("kept_fraction", HOURLY + ", m AS (SELECT channel, avg(x) AS m, stddev_pop(x) AS s FROM sig GROUP BY 1) SELECT channel AS label, round(avg(CASE WHEN abs(x - m) <= 1.5 * s THEN 1.0 ELSE 0.0 END), 5) + 0.0 AS share FROM sig JOIN m USING (channel) GROUP BY 1")
def _(spark, d):
    sig = S.hourly(spark, d)
    m = sig.groupBy("channel").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    on = sig.join(m, "channel").select(F.col("channel").alias("label"), "t", (F.abs(F.col("x") - F.col("m")) <= 1.5 * F.col("s")).alias("on"))
    return shown(views.kept_fraction(on), "label", digits=5)


@query("tradeoff_summary", METRICS + " SELECT grp, round(avg(chars), 3) + 0.0 AS x, round(avg(spaces), 3) + 0.0 AS y, round(avg(chars - spaces), 3) + 0.0 AS mean, round(stddev_samp(chars - spaces) / sqrt(count(*)), 3) + 0.0 AS sem FROM m GROUP BY 1")
def _(spark, d):
    data = metric_table(spark, d).withColumn("solid", F.col("chars") - F.col("spaces"))
    return shown(views.tradeoff_summary(data.where("grp is not null"), "chars", "spaces", "solid", "grp"), "grp", digits=3)


@query("denoising_summary", SMOOTH + " SELECT channel, round(sqrt(avg(x * x)), 4) + 0.0 AS before, round(sqrt(avg((x - y) * (x - y))), 4) + 0.0 AS after, round(sqrt(avg(y * y)), 4) + 0.0 AS removed, round(corr(x, x - y), 4) + 0.0 AS r FROM sm GROUP BY 1")
def _(spark, d):
    return shown(views.denoising_summary(*smooth_pair(spark, d)), "channel")


@query("diagnostics_summary", HOURLY + ", r AS (SELECT t, x AS ref FROM sig WHERE channel = 'view') SELECT channel AS grp, round(sqrt(avg(x * x)), 4) + 0.0 AS rms, round(max(x) - min(x), 4) + 0.0 AS spread, round(corr(x, ref), 4) + 0.0 AS r FROM sig JOIN r USING (t) GROUP BY 1")
def _(spark, d):
    return shown(views.diagnostics_summary(S.hourly(spark, d).withColumnRenamed("channel", "grp"), "view"), "grp")


@query("signed_autocorrelations", HOURLY + " SELECT a.channel, round(corr(a.x, b.x), 5) + 0.0 AS r FROM sig a JOIN sig b ON a.channel = b.channel AND b.t = a.t - 3 GROUP BY 1")
def _(spark, d):
    return shown(references.signed_autocorrelations(S.hourly(spark, d), 3), "channel", digits=5)


@query("sensor_whitener", HOURLY + " SELECT channel, round(1 / stddev_pop(x), 7) + 0.0 AS w FROM sig GROUP BY 1")
def _(spark, d):
    return shown(moments.sensor_whitener(S.hourly(spark, d)), "channel", digits=7)


@query("padded_rows", """WITH o AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS pos, CAST(l_quantity AS DOUBLE) AS x FROM lineitem),
g AS (SELECT k, i FROM (SELECT DISTINCT k FROM o) CROSS JOIN (SELECT unnest(range(0, (SELECT max(pos) + 1 FROM o))) AS i))
SELECT g.k, CAST(g.i AS INTEGER) AS i, coalesce(round(x, 4), -1.0) AS x FROM g LEFT JOIN o ON o.k = g.k AND o.pos = g.i""")
def _(spark, d):
    rows = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_quantity").alias("o"), F.col("l_quantity").alias("x"))
    out = moments.padded(rows, "k", "o", "x").select("k", F.posexplode("xs").alias("i", "x"))
    return out.select("k", "i", F.when(F.isnan("x"), -1.0).otherwise(F.round("x", 4)).alias("x"))


@query("window_starts", HOURLY + ", s AS (SELECT unnest(range(0, (SELECT n - 99 FROM nn), 70)) AS start UNION SELECT n - 100 FROM nn) SELECT CAST(start AS BIGINT) AS start FROM s")
def _(spark, d):
    return spark.createDataFrame([(s,) for s in windows.window_starts(hours(S.hourly(spark, d)), 100, 70)], "start long")


@query("lead_field")
def _(spark, d):
    """Sensors are the channels of the vectors."""
    names = S.channels_of(S.vectors(spark, d))
    gain, _ = head.lead_field(L.spherical_points(len(names)), 20)
    rows = [(c, k // 3, "xyz"[k % 3], float(g)) for c, row in zip(names, gain, strict=True) for k, g in enumerate(row)]
    return spark.createDataFrame(rows, "channel string, dipole int, axis string, gain double")


@query("source_informed_best_reference")
def _(spark, d):
    return references.source_informed_best_reference(S.vectors(spark, d), _lead(64))[0]


@query("asr_log")
def _(spark, d):
    sig, n, state = _calibrated(spark, d)
    return asr.process(sig, state, 24.0, n, 1.0, chunk=240, log=True).drop("variances", "limits", "weights")


@query("asr_repair_ratios")
def _(spark, d):
    sig, n, state = _calibrated(spark, d)
    return views.repair_ratios(asr.process(sig, state, 24.0, n, 1.0, chunk=240, log=True))


@query("asr_diagnostics")
def _(spark, d):
    sig, n, state = _calibrated(spark, d)
    return asr.diagnostics(asr.process(sig, state, 24.0, n, 1.0, chunk=240, log=True))


@query("asr_calibration_mask")
def _(spark, d):
    sig = _trend(spark, d)
    return asr.calibration_mask(sig, 24.0, hours(sig))


@query("asr_rejection_mask")
def _(spark, d):
    sig, n, state = _calibrated(spark, d)
    return asr.rejection_mask(asr.process(sig, state, 24.0, n, 1.0, chunk=240, log=True))


@query("asr_riemannian")
def _(spark, d):
    sig = _trend(spark, d)
    n = hours(sig)
    return asr.process(sig, asr.calibrate(sig, 24.0, n, 3.0, length=1.0, mean="karcher"), 24.0, n, 1.0, chunk=240, alpha=1.0)


@query("asr_riemannian_global")
def _(spark, d):
    sig, n, state = _calibrated(spark, d)
    return asr.process_globally(sig, state, n, 12)


@query("asr_adaptive")
def _(spark, d):
    """Calibrated on the first two thirds, taught by the rest, and applied to all."""
    sig = _trend(spark, d)
    n = hours(sig)
    cut = 2 * n // 3
    model = asr.adaptive_fit(sig.where(F.col("t") < cut), 24.0, cut, 3.0, length=1.0)
    model = asr.partial_fit(model, sig.where(F.col("t") >= cut).withColumn("t", F.col("t") - cut), 24.0, n - cut, 3.0, 1.0)
    return asr.process(sig, model.state, 24.0, n, 1.0, chunk=240)


@query("asr_moving_window")
def _(spark, d):
    sig = _trend(spark, d)
    n = hours(sig)
    return asr.process(sig, asr.moving_fit(sig, 24.0, n, 20.0, cutoff=3.0, length=1.0), 24.0, n, 1.0, chunk=240)


@query("component_summary")
def _(spark, d):
    sig = _trend(spark, d)
    return views.component_summary(dss.smooth(sig, DAY), sig)


@query("cleaning_summary")
def _(spark, d):
    sig = _trend(spark, d)
    model = dss.smooth(sig, DAY)
    return views.cleaning_summary(list(model.scores), [0], sig, model.remove(sig, [0]))


@query("component_spectrogram")
def _(spark, d):
    sig = _trend(spark, d)
    return views.spectrogram(dss.smooth(sig, DAY).sources(sig).where("channel = 's000'"), 24.0, 48)


@query("dss_iterative_damped")
def _(spark, d):
    sig = S.vectors(spark, d)
    model, _ = dss.iterative(sig, 1, rounds=60, tol=1e-4, gamma=dss.gamma_predictive, rank=8)
    return model.table(sig)
