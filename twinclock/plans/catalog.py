"""Queries over the driver's tables, each bound to the operators, and plain SQL for an independent engine.

A run is a `user_id`, time is `ts` in seconds since the table's day one, a code is an `event_type`, a signal is `value` in order
of (ts, event_id). Numbers are rounded on both sides, since sums differ in the last digit between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import numbers as X
from ..functions import times as T
from ..operators import coupling, edges, fit, match, projection, regions, reports, signals, synergies, tables, trials
from ..sources import datasets, recordings, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common tables of the SQL: events in seconds, with the stream's order.
E_SQL = "e as (select user_id as run, epoch_us(ts) / 1e6 - 1.7e9 as t, event_id as ord, event_type as code, value, props from events)"
PAIR_SQL = E_SQL + """, kb as (select run, t, row_number() over (partition by run order by t, ord) as k from e where code = 'view'),
bp as (select run, t, row_number() over (partition by run order by t, ord) as k from e where code = 'click'),
pairs as (select a.run, a.k, a.t as t_keyboard, b.t as t_beep, a.t_next from (select *, lead(t) over (partition by run order by k) as t_next from kb) a join bp b using (run, k))"""
LINE_SQL = E_SQL + """, p as (select run, ord::double as x, value as y from e),
f as (select run, count(*) as n, regr_slope(y, x) as a, regr_intercept(y, x) as b from p group by run having regr_slope(y, x) is not null),
m as (select p.run, median(abs(p.y - f.a * p.x - f.b)) as mad from p join f using (run) group by p.run)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events")
    return df.select(F.col("user_id").alias("run"), (T.micros(df, "ts") / 1e6 - 1.7e9).alias("t"), F.col("event_id").alias("ord"), F.col("event_type").alias("code"), "value", "props")


def stream(spark: SparkSession, d: str, code: str) -> DataFrame:
    return fit.numbered(events(spark, d).where(F.col("code") == code), ["run"], ["t", "ord"]).select("run", "k", "t", "ord")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return trials.paired(stream(spark, d, "view").drop("ord"), stream(spark, d, "click").drop("ord"), ["run"])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and minus zero made zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("with " + E_SQL + """, s as (select *, row_number() over (partition by run order by t, ord) as i from e where value is not null),
l as (select run, (list_sort(list(value) filter (i <= 20000))[len(list(value) filter (i <= 20000)) // 2 + 1] + min(value)) / 2 as level from s group by run),
b as (select s.*, s.value < l.level as low, lag(s.value < l.level, 1, false) over (partition by run order by i) as before from s join l using (run))
select run, ord, i, round(t, 6) as t from b where low and not before""")
def falling_edges(spark, d):
    return rounded(edges.falling_edges(events(spark, d), ["run"], ["t", "ord"], "value").select("run", "ord", F.col("i").cast("long").alias("i"), "t"))


@query("with recursive " + E_SQL + """, r as (select run, min(t) as t from e group by run union all
select r.run, (select min(e.t) from e where e.run = r.run and e.t - r.t >= 43200) from r where r.t is not null)
select run, round(t, 6) as t from r where t is not null""")
def min_gap(spark, d):
    return rounded(edges.min_gap(events(spark, d), ["run"], "t", 43200.0))


@query("with " + E_SQL + ", s as (select run, t - lag(t) over (partition by run order by t, ord) as step from e) select run, round(median(step), 6) as step_median from s group by run")
def step_median(spark, d):
    return rounded(edges.step_median(events(spark, d), ["run"], ["t", "ord"], "t"))


@query("with " + E_SQL + ", c as (select run, count(*) filter (code = 'view') as n_edges, count(*) filter (code = 'click') as n_expected from e group by run) select *, case when n_expected <= 0 then true else n_edges between greatest(10, floor(n_expected * 0.6)) and ceil(n_expected * 1.8) end as plausible from c")
def count_plausibility(spark, d):
    n = events(spark, d).groupBy("run").agg(F.count_if(F.col("code") == "view").alias("n_edges"), F.count_if(F.col("code") == "click").alias("n_expected"))
    return n.withColumn("plausible", edges.plausible_count(F.col("n_edges"), F.col("n_expected")))


@query("with " + E_SQL + " select run, code, count(*) as n from e group by run, code")
def code_counts(spark, d):
    return edges.code_counts(events(spark, d), ["run"], "code")


@query("with " + E_SQL + " select run, ord, code, row_number() over (partition by run order by t, ord) as gidx, row_number() over (partition by run, code order by t, ord) as cidx from e")
def running_counters(spark, d):
    out = edges.counters(events(spark, d), ["run"], ["t", "ord"], "code")
    return out.select("run", "ord", "code", F.col("gidx").cast("long").alias("gidx"), F.col("cidx").cast("long").alias("cidx"))


LAG_SQL = E_SQL + """, a as (select run, t as x, row_number() over (partition by run order by t, ord) as k from e where code = 'view'),
b as (select run, t as y, row_number() over (partition by run order by t, ord) as k from e where code = 'click'),
c as (select run, t as x, row_number() over (partition by run order by t, ord) as k from e where code = 'error'),
g as (select run, t as y, row_number() over (partition by run order by t, ord) as k from e where code = 'purchase'),
lags as (select unnest(range(-8, 9)) as lag)"""


@query("with " + LAG_SQL + " select b.run, lag, b.k, round(a.x, 6) as x, round(b.y, 6) as y from lags join a on true join b on b.run = a.run and b.k = a.k - lag")
def ordinal_lag_pairs(spark, d):
    x, y = stream(spark, d, "view"), stream(spark, d, "click")
    out = fit.ordinal_pairs(x.select("run", "k", F.col("t").alias("x")), y.select("run", "k", F.col("t").alias("y")), ["run"], [*range(-8, 9)])
    return rounded(out.select("run", F.col("lag").cast("long").alias("lag"), F.col("k").cast("long").alias("k"), "x", "y"))


@query("with " + LAG_SQL + """, pa as (select b.run, lag, a.x, b.y from lags join a on true join b on b.run = a.run and b.k = a.k - lag),
pb as (select g.run, lag, c.x, g.y from lags join c on true join g on g.run = c.run and g.k = c.k - lag),
na as (select run, lag from pa group by all having count(*) >= 10), nb as (select run, lag from pb group by all having count(*) >= 10),
grid as (select na.run, na.lag as la, nb.lag as lb from na join nb using (run)),
pts as (select grid.run, la, lb, x, y from grid join pa on pa.run = grid.run and pa.lag = la union all select grid.run, la, lb, x, y from grid join pb on pb.run = grid.run and pb.lag = lb),
f as (select run, la, lb, count(*) as n, regr_slope(y, x) as a, regr_intercept(y, x) as b from pts group by all),
m as (select f.run, f.la, f.lb, any_value(f.n) as n, any_value(f.a) as a, median(abs(y - f.a * x - f.b)) as mad from pts join f using (run, la, lb) group by f.run, f.la, f.lb),
r as (select *, row_number() over (partition by run order by round(mad + 1e-9 * abs(a - 1), 2), la, lb) as k from m)
select run, la::bigint as lag_a, lb::bigint as lag_b, n, round(a, 6) as a, round(mad, 3) as mad from r where k = 1""")
def lag_grid_best(spark, d):
    of = lambda code, to: stream(spark, d, code).select("run", "k", F.col("t").alias(to))
    out = fit.best_lags((of("view", "x"), of("click", "y")), (of("error", "x"), of("purchase", "y")), ["run"], digits=2)
    return out.select("run", F.col("lag_a").cast("long").alias("lag_a"), F.col("lag_b").cast("long").alias("lag_b"), "n", F.round("a", 6).alias("a"), F.round("mad", 3).alias("mad"))


@query("with " + LINE_SQL + " select f.run, n, round(a, 9) as a, round(b, 5) as b, round(mad, 6) as mad, round((a - 1) * 1e6, 2) as drift_ppm, coalesce(abs(a - 1) <= 0.02 and mad <= 0.5, false) as stable from f join m using (run)")
def clock_fit(spark, d):
    p = events(spark, d).select("run", F.col("ord").cast("double").alias("x"), F.col("value").alias("y"))
    out = fit.linear(p, ["run"])
    return out.select("run", "n", F.round("a", 9).alias("a"), F.round("b", 5).alias("b"), F.round("mad", 6).alias("mad"), F.round(fit.drift_ppm(F.col("a")), 2).alias("drift_ppm"), fit.stable(F.col("a"), F.col("mad")).alias("stable"))


@query("with " + LINE_SQL + """, q as (select run, arg_min(x, x) as x0, arg_min(y, x) as y0, arg_max(x, x) as x1, arg_max(y, x) as y1 from p group by run having max(x) > min(x)),
l as (select run, (y1 - y0) / (x1 - x0) as a, y0 - (y1 - y0) / (x1 - x0) * x0 as b from q),
w as (select l.run, l.a, l.b, median(abs(p.y - l.a * p.x - l.b)) as mad from p join l using (run) group by l.run, l.a, l.b)
select f.run, round(case when w.mad <= m.mad then w.a else f.a end, 9) as a, round(least(m.mad, coalesce(w.mad, m.mad)), 6) as mad from f join m using (run) left join w using (run)""")
def endpoint_fit(spark, d):
    p = events(spark, d).select("run", F.col("ord").cast("double").alias("x"), F.col("value").alias("y"))
    out = fit.better_line(fit.linear(p, ["run"]), fit.endpoint_line(p, ["run"]), ["run"])
    return out.select("run", F.round("a", 9).alias("a"), F.round("mad", 6).alias("mad"))


@query("with " + E_SQL + """, m as (select run, median(value) as med from e group by run), s as (select e.run, med, median(abs(value - med)) as dev from e join m using (run) group by e.run, med)
select e.run, e.ord, e.value from e join s using (run) where abs(value - med) <= greatest(3 * dev, 0.003)""")
def outlier_3mad(spark, d):
    return fit.without_outliers(events(spark, d).select("run", "ord", "value"), ["run"], "value", 0.003)


@query("with " + PAIR_SQL + " select run, k, round(t_keyboard, 6) as t_keyboard, round(t_beep, 6) as t_beep from pairs where t_keyboard + 0.05 < t_beep and (t_next is null or t_beep < t_next)")
def valid_trials(spark, d):
    return rounded(trials.valid(pairs(spark, d)).select("run", F.col("k").cast("long").alias("k"), "t_keyboard", "t_beep"))


AFTER_SQL = E_SQL + """, v as (select run, t, ord, lead(t) over (partition by run order by t, ord) as t_next from e where code = 'view'),
s as (select run, t from e where code = 'purchase')"""


@query("with " + AFTER_SQL + " select v.run, v.ord, round(v.t, 6) as t, round(min(s.t), 6) as t_start from v join s on s.run = v.run and s.t > v.t and (v.t_next is null or s.t < v.t_next) group by v.run, v.ord, v.t")
def trial_windows_asof(spark, d):
    out = trials.first_before_next(stream(spark, d, "view"), stream(spark, d, "purchase"), ["run"], ["t", "ord"])
    return rounded(out.select("run", "ord", "t", "t_start"))


@query("with " + AFTER_SQL + """, w as (select v.run, v.ord, v.t, min(s.t) as t_start from v join s on s.run = v.run and s.t > v.t and (v.t_next is null or s.t < v.t_next) group by v.run, v.ord, v.t),
n as (select run, floor(max(t) * 0.01) as n from e group by run),
i as (select run, ord, greatest(floor(t * 0.01) + 1, 1)::bigint as i1, least(ceil(t_start * 0.01), n)::bigint as i2 from w join n using (run)) select * from i where i2 > i1 and i2 - i1 + 1 >= 50""")
def event_trials(spark, d):
    w = trials.first_before_next(stream(spark, d, "view"), stream(spark, d, "purchase"), ["run"], ["t", "ord"])
    w = w.join(events(spark, d).groupBy("run").agg(F.floor(F.max("t") * 0.01).alias("n")), "run")
    return trials.event_trials(w, ["run", "ord"], 0.01, F.col("n"), clamp_long=False)


@query("with " + AFTER_SQL + """, w as (select v.run, v.ord, v.t, min(s.t) as t_start from v join s on s.run = v.run and s.t > v.t and (v.t_next is null or s.t < v.t_next) group by v.run, v.ord, v.t),
n as (select run, floor(max(t) * 0.02) as n from e group by run),
i as (select run, ord, greatest(floor((t - 1000) * 0.02) + 1, 1)::bigint as i1, least(ceil((t_start + 1000) * 0.02), n)::bigint as i2 from w join n using (run)) select * from i where i2 > i1 and i2 - i1 + 1 >= 50""")
def seconds_to_trials(spark, d):
    w = trials.first_before_next(stream(spark, d, "view"), stream(spark, d, "purchase"), ["run"], ["t", "ord"])
    w = w.join(events(spark, d).groupBy("run").agg(F.floor(F.max("t") * 0.02).alias("n")), "run").withColumns({"t_from": F.col("t") - 1000, "t_to": F.col("t_start") + 1000})
    return trials.seconds_to_trials(w, ["run", "ord"], 0.02, F.col("n"))


@query("with " + E_SQL + """, r as (select run, min(t) as t0, max(t) as t1 from e group by run),
b as (select run, ord, t - t0 as t, floor((t1 - t0) * 0.001) as n from e join r using (run) where code = 'view'),
i as (select run, ord, (floor((t - 3600) * 0.001) + 1)::bigint as i1, (floor((t + 60000) * 0.001) + 1)::bigint as i2 from b where t - 3600 >= 0 and t + 60000 <= (n - 1) / 0.001)
select run, ord, i1, i2 from i where i2 > i1 and i2 - i1 + 1 >= 50""")
def fixed_epochs(spark, d):
    e = events(spark, d)
    r = e.groupBy("run").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    b = e.where("code = 'view'").join(r, "run").select("run", "ord", (F.col("t") - F.col("t0")).alias("t"), (F.col("t1") - F.col("t0")).alias("dur"))
    return trials.fixed_epochs(b, ["run", "ord"], 0.001, F.floor(F.col("dur") * 0.001), 3600.0, 60000.0).drop("t")


TEMPLATE_SQL = E_SQL + """, c as (select run, t, case code when 'view' then 'DIN4' when 'click' then 'DIN5' when 'purchase' then 'start' when 'error' then 'beep' end as code from e),
k as (select *, row_number() over (partition by run, code order by t desc) as k from c where code is not null)"""


def templates(spark, d):
    named = F.create_map(*[F.lit(x) for pair in (("view", "DIN4"), ("click", "DIN5"), ("purchase", "start"), ("error", "beep")) for x in pair])
    return events(spark, d).select("run", "t", F.try_element_at(named, F.col("code")).alias("code")).where("code is not null")


@query("with " + TEMPLATE_SQL + " select a.run, a.k, a.code, round(a.t - b.t, 6) as offset from k a join k b on a.run = b.run and a.k = b.k and b.code = case a.code when 'start' then 'DIN4' else 'DIN5' end where a.code in ('start', 'beep')")
def template_offsets(spark, d):
    return rounded(trials.template_offsets(templates(spark, d), ["run"]).withColumn("k", F.col("k").cast("long")))


@query("with " + E_SQL + """, v as (select run, list(value order by t, ord) as v from e group by run), i as (select run, v, unnest(range(0, 7)) as i from v), p as (select *, i * (len(v) - 1) / 6.0 as k from i)
select run, i, round(v[floor(k)::int + 1] + (v[least(floor(k)::int + 1, len(v) - 1) + 1] - v[floor(k)::int + 1]) * (k - floor(k)), 6) as x from p""")
def resampled_offsets(spark, d):
    v = F.transform(F.array_sort(F.collect_list(F.struct("t", "ord", "value"))), lambda x: x["value"])
    own = events(spark, d).groupBy("run").agg(v.alias("v")).select("run", F.posexplode(trials.resampled(F.col("v"), F.lit(7))).alias("i", "x"))
    return rounded(own.withColumn("i", F.col("i").cast("long")))


REBUILD_SQL = PAIR_SQL + """, m as (select run, max(t) as dur from e group by run),
v as (select p.run, p.k, t_keyboard - 600 as ts, t_keyboard as tk, t_beep as tb, t_beep + 300 as te, t_next, dur from pairs p join m using (run) where t_keyboard + 0.05 < t_beep and (t_next is null or t_beep < t_next)),
o as (select * from v where ts < tk and tk < tb and tb < te and (t_next is null or te < t_next)),
c as (select run, k, t_next, least(greatest(ts, 0), greatest(dur - 1e-6, 0)) as ts, least(greatest(tk, 0), greatest(dur - 1e-6, 0)) as tk, least(greatest(tb, 0), greatest(dur - 1e-6, 0)) as tb, least(greatest(te, 0), greatest(dur - 1e-6, 0)) as te from o),
z as (select run, row_number() over (partition by run order by k) as trial, ts, tk, tb, te from c where ts < tk and tk < tb and tb < te and (t_next is null or te < t_next))"""


def rebuilt(spark, d):
    e = events(spark, d)
    own = trials.valid(pairs(spark, d)).join(e.groupBy("run").agg(F.max("t").alias("dur")), "run")
    return trials.reconstructed(own, ["run"], F.col("dur"), {"start": -600.0, "end": 300.0})


@query("with " + REBUILD_SQL + """, u as (select run, unnest([{'t': ts, 'code': 'start'}, {'t': tk, 'code': 'keyboard'}, {'t': tb, 'code': 'beep'}, {'t': te, 'code': 'end'}]) as x from z)
select run, round(x.t, 6) as t, x.code as code from u union all select run, round(t, 6), code from e where code in ('view', 'click')""")
def reconstruct_events(spark, d):
    e = events(spark, d).where(F.col("code").isin("view", "click"))
    return rounded(trials.task_events(rebuilt(spark, d), e, ["run"]))


@query("with " + REBUILD_SQL + """, w as (select run, trial, (tb - 3.1) / 1.00002 as sf, (te - 3.1) / 1.00002 as st from z),
s as (select run, trial, greatest(floor(sf * 0.5) + 1, 1)::bigint as i1, ceil(st * 0.5)::bigint as i2 from w)
select run, trial, 'beep_to_end_fallback' as rule_used, row_number() over (partition by run order by i1, trial) as segment_id, i1 as sample_start, i2 as sample_stop, i2 - i1 + 1 as n_samples, round((i2 - i1 + 1) / 0.5, 6) as duration_s from s where i2 >= i1""")
def segments_samples(spark, d):
    w = trials.movement_windows(rebuilt(spark, d), ["run"]).withColumns({"a": F.lit(1.00002), "b": F.lit(3.1)})
    out = trials.segments(w, ["run"], 0.5, F.lit(1 << 60)).withColumn("trial", F.col("trial").cast("long"))
    return rounded(out.select("run", "trial", "rule_used", "segment_id", "sample_start", "sample_stop", "n_samples", "duration_s"))


def shipped(spark, d):
    """Order days (reference) and ship days (predicted) by customer, as two event streams in days."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    ref = o.select(F.col("o_custkey").alias("run"), (T.micros(o, "o_orderdate") / 86400e6).alias("t"))
    pred = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("run"), (T.micros(li, "l_shipdate") / 86400e6).alias("t"))
    return pred, ref


MATCH_SQL = """recursive p as (select o_custkey as run, list_sort(list(epoch_us(l_shipdate::timestamp) / 86400e6)) as a from lineitem join orders on l_orderkey = o_orderkey group by o_custkey),
r as (select o_custkey as run, list_sort(list(epoch_us(o_orderdate::timestamp) / 86400e6)) as b from orders group by o_custkey),
s as (select coalesce(p.run, r.run) as run, coalesce(a, []) as a, coalesce(b, []) as b from p full join r on p.run = r.run),
w as (select run, 1 as i, 1 as j, null::double as t_pred, null::double as t_ref from s union all
select run, i + i_, j + j_, case when i_ = 1 then a[i] end, case when j_ = 1 then b[j] end from (
select w.run, i, j, a, b, case when i > len(a) then 0 when j > len(b) or abs(a[i] - b[j]) <= 30 or a[i] < b[j] then 1 else 0 end as i_, case when j > len(b) then 0 when i > len(a) or abs(a[i] - b[j]) <= 30 or a[i] > b[j] then 1 else 0 end as j_
from w join s on s.run = w.run where i <= len(a) or j <= len(b))),
m as (select run, t_pred, t_ref, 1000 * (t_pred - t_ref) as res_ms from w where t_pred is not null or t_ref is not null)"""


@query("with " + MATCH_SQL + " select run, round(t_pred, 6) as t_pred, round(t_ref, 6) as t_ref, round(res_ms, 6) as res_ms from m")
def event_match_tolerance(spark, d):
    pred, ref = shipped(spark, d)
    return rounded(match.matched(pred, ref, ["run"], 30.0))


@query("with " + MATCH_SQL + """ select run, count(t_pred) as n_pred, count(t_ref) as n_ref, count(res_ms) as n_match, round(median(abs(res_ms)), 6) as median_ms, round(quantile_cont(abs(res_ms), 0.95), 6) as p95_ms, round(max(abs(res_ms)), 6) as max_ms,
round(count(res_ms) / nullif(count(t_ref), 0), 6) as recall, round(count(res_ms) / nullif(count(t_pred), 0), 6) as precision from m group by run""")
def recall_precision(spark, d):
    pred, ref = shipped(spark, d)
    return rounded(match.metrics(match.matched(pred, ref, ["run"], 30.0), ["run"]))


@query("with " + MATCH_SQL + """, c as (select *, case when run % 2 = 0 then 'DIN4' else 'DIN1' end as code, case when t_pred is null then 'missing' when t_ref is null then 'extra' when abs(res_ms) / 1000 > case when run % 2 = 0 then 20 else 30 end then 'residual' end as issue from m)
select run, code, issue, round(coalesce(t_ref, t_pred), 6) as t, round(res_ms / 1000, 6) as res_ms, case when issue = 'extra' then case code when 'DIN4' then 'MED' else 'LOW' end else case code when 'DIN4' then 'HIGH' else 'MED' end end as severity from c where issue is not null""")
def blockers(spark, d):
    pred, ref = shipped(spark, d)
    own = match.matched(pred, ref, ["run"], 30.0).withColumns({"code": F.when(F.col("run") % 2 == 0, "DIN4").otherwise("DIN1"), "res_ms": F.col("res_ms") / 1000})
    return rounded(match.blockers(own, ["run", "code"], "code", match.limit_ms(F.col("code"))))


@query("with " + MATCH_SQL + """, c as (select run, t_pred, t_ref, res_ms / 1000 as res, case when run % 2 = 0 then 'DIN4' else 'DIN1' end as code, case when run % 2 = 0 then 20 else 30 end as hard from m)
select run, code, case when t_pred is null then 'missing_event' when t_ref is null then 'extra_event' else 'large_residual' end as issue, case when t_ref is null then case code when 'DIN4' then 'MED' else 'LOW' end else case code when 'DIN4' then 'HIGH' else 'MED' end end as severity,
coalesce(printf('%.6f', t_ref), '') as time_mff_s, coalesce(printf('%.6f', t_pred), '') as time_pred_s, coalesce(printf('%.3f', res), '') as delta_ms, case when t_pred is null then 'Event in MFF not matched' when t_ref is null then 'Event in OTB not matched' else '|delta|>' || hard || ' ms' end as note from c where res is null or abs(res) > hard""")
def blocker_table(spark, d):
    pred, ref = shipped(spark, d)
    own = match.matched(pred, ref, ["run"], 30.0).withColumns({"code": F.when(F.col("run") % 2 == 0, "DIN4").otherwise("DIN1"), "res_ms": F.col("res_ms") / 1000})
    return match.blocker_table(own, ["run", "code"], "code", match.limit_ms(F.col("code")))


READY_SQL = """m as (select user_id as run, count(*) filter (event_type = 'view') as n_din4, count(*) filter (event_type = 'click') as n_din5,
case when count(*) filter (event_type = 'click') > 0 then least(1.0, count(*) filter (event_type = 'view') / count(*) filter (event_type = 'click')::double) end as recall_din4,
case when count(*) filter (event_type = 'error') > 0 then least(1.0, count(*) filter (event_type = 'purchase') / count(*) filter (event_type = 'error')::double) end as recall_din5,
quantile_cont(value, 0.5) / 10 as median_ms, quantile_cont(value, 0.95) / 10 as p95_ms, quantile_cont(value, 0.25) / 20 as mad_ms, 0 as n_high, (avg(value) - 50) * 100 as drift_ppm from events group by user_id),
k as (select *, n_din4 >= 20 and n_din5 >= 20 as c1, coalesce(recall_din4 >= 0.95 and recall_din5 >= 0.95, false) as c2, coalesce(median_ms <= 5 and p95_ms <= 15, false) as c3, coalesce(mad_ms <= 2, false) as c4, n_high <= 0 as c5 from m)"""


@query("with " + READY_SQL + """, d as (select *, coalesce(abs(drift_ppm) > 5000, false) as drift from k),
r as (select *, list_filter([case when not c1 then 'insufficient_trials' end, case when not c2 then 'low_recall' end, case when not c3 then 'high_residuals' end, case when not c4 then 'high_fit_error' end, case when not c5 then 'blocking_differences' end], lambda x: x is not null) as why from d)
select run, len(why) = 0 as ready, case when len(why) > 0 then array_to_string(why || case when drift then ['high_clock_drift_warning'] else [] end, ';') when drift then 'alignment_good_for_csc_high_drift_corrected' else 'alignment_good_for_csc' end as reason, drift as drift_warning,
round(greatest(median_ms - 5, 0), 6) as over_median_ms, round(greatest(p95_ms - 15, 0), 6) as over_p95_ms, round(greatest(0.95 - least(recall_din4, recall_din5), 0), 6) as under_recall, round(greatest(median_ms - 5, p95_ms - 15, mad_ms - 2, 0), 6) as excess_ms, 15.0::double as threshold_ms, round(15 - p95_ms, 6) as margin_ms from r""")
def readiness_verdict(spark, d):
    out = match.readiness(run_metrics(spark, d), match.criteria(spark), "standard")
    return rounded(out.select("run", "ready", "reason", "drift_warning", "over_median_ms", "over_p95_ms", "under_recall", "excess_ms", "threshold_ms", "margin_ms"))


@query("with " + READY_SQL + """, x as (select run, unnest([
{'check': 'n_din4', 'threshold': '>= 20', 'v': n_din4::double, 'ok': n_din4 >= 20}, {'check': 'n_din5', 'threshold': '>= 20', 'v': n_din5::double, 'ok': n_din5 >= 20},
{'check': 'recall_din4', 'threshold': '>= 0.95', 'v': recall_din4, 'ok': recall_din4 >= 0.95}, {'check': 'recall_din5', 'threshold': '>= 0.95', 'v': recall_din5, 'ok': recall_din5 >= 0.95},
{'check': 'median_ms', 'threshold': '<= 5.0', 'v': median_ms, 'ok': median_ms <= 5}, {'check': 'p95_ms', 'threshold': '<= 15.0', 'v': p95_ms, 'ok': p95_ms <= 15},
{'check': 'mad_ms', 'threshold': '<= 2.0', 'v': mad_ms, 'ok': mad_ms <= 2}, {'check': 'n_high', 'threshold': '<= 0', 'v': n_high::double, 'ok': n_high <= 0}, {'check': 'drift_ppm', 'threshold': 'warning if > 5000', 'v': drift_ppm, 'ok': true}]) as x from m)
select run, x.check as "check", x.threshold as threshold, round(x.v + 1e-7, 4) as value, case when coalesce(x.ok, false) then 'TRUE' else 'FALSE' end as pass, case when x.check = 'drift_ppm' and abs(x.v) > 5000 then 'HIGH DRIFT WARNING (corrected in alignment)' else '' end as note from x""")
def readiness_checks(spark, d):
    out = match.check_rows(run_metrics(spark, d), match.criteria(spark), ["run"], "standard")
    return rounded(out.withColumn("value", X.number(F.col("value")) + 1e-7), 4)  # engines differ in the last digits of a mean


def run_metrics(spark, d):
    e = events(spark, d)
    n = lambda c: F.count_if(F.col("code") == c)
    share = lambda a, b: F.when(n(b) > 0, F.least(F.lit(1.0), F.try_divide(n(a).cast("double"), n(b).cast("double"))))
    return e.groupBy("run").agg(n("view").alias("n_din4"), n("click").alias("n_din5"), share("view", "click").alias("recall_din4"), share("purchase", "error").alias("recall_din5"), (X.percentile_n1(F.col("value"), 0.5) / 10).alias("median_ms"), (X.percentile_n1(F.col("value"), 0.95) / 10).alias("p95_ms"), (X.percentile_n1(F.col("value"), 0.25) / 20).alias("mad_ms"), ((F.avg("value") - 50) * 100).alias("drift_ppm")).withColumn("n_high", F.lit(0))


ORDERS_SQL = """o as (select o_custkey as key, case when o_orderstatus = 'F' then 'pre' else 'post' end as phase, case when o_orderpriority < '3' then 'dx' else 'sx' end as side, o_totalprice as drift_ppm, o_orderkey as ord from orders)"""


def sessions(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "pre").otherwise("post").alias("phase"), F.when(F.col("o_orderpriority") < "3", "dx").otherwise("sx").alias("side"), F.col("o_totalprice").alias("drift_ppm"), F.col("o_orderkey").alias("ord"))


@query("with " + ORDERS_SQL + ", f as (select key, phase, arg_min(drift_ppm, ord) as v from o group by key, phase) select a.key, round(a.v, 4) as drift_ppm_pre, round(b.v, 4) as drift_ppm_post, round(b.v - a.v, 4) as drift_ppm_delta, case when b.v - a.v > 1000 then 'up' when b.v - a.v < -1000 then 'down' else 'flat' end as trend from f a join f b on a.key = b.key and a.phase = 'pre' and b.phase = 'post'")
def prepost_delta(spark, d):
    out = reports.difference(sessions(spark, d), ["key"], "phase", "pre", "post", ["ord"], ["drift_ppm"])
    return rounded(out.withColumn("trend", reports.trend(F.col("drift_ppm_delta"), 1000.0)), 4)


@query("with " + ORDERS_SQL + ", f as (select key, phase, side, arg_min(drift_ppm, ord) as v from o group by all) select a.key, a.phase, round(a.v, 4) as drift_ppm_dx, round(b.v, 4) as drift_ppm_sx, round(b.v - a.v, 4) as drift_ppm_delta from f a join f b on a.key = b.key and a.phase = b.phase and a.side = 'dx' and b.side = 'sx'")
def side_delta(spark, d):
    return rounded(reports.difference(sessions(spark, d), ["key", "phase"], "side", "dx", "sx", ["ord"], ["drift_ppm"]), 4)


@query("with " + ORDERS_SQL + """, f as (select key, phase, side, arg_min(drift_ppm, ord) as v from o group by all)
select 'session' as row_type, key, phase, side, round(drift_ppm, 4) as drift_ppm from o union all
select 'post_pre', a.key, null, a.side, round(b.v - a.v, 4) from f a join f b on a.key = b.key and a.side = b.side and a.phase = 'pre' and b.phase = 'post' union all
select 'sx_dx', a.key, a.phase, null, round(b.v - a.v, 4) from f a join f b on a.key = b.key and a.phase = b.phase and a.side = 'dx' and b.side = 'sx'""")
def drift_union(spark, d):
    return rounded(reports.drift_rows(sessions(spark, d), ["ord"]), 4)


@query(r"""with w as (select p_partkey, string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ') as w from part)
select p_partkey, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x <> '' and x not in ('eeg', 'emg', 'otb', 'mff', 'sub', 'ses', 'pre', 'post', 'aligned', 'session') and not regexp_full_match(x, '[a-z]*[0-9]+')))), ' ') as words from w""")
def name_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(N.tokens(F.col("p_name")), " ").alias("words"))


@query(r"""with w as (select p_partkey, p_brand, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '' and x not in ('eeg', 'emg', 'otb', 'mff', 'sub', 'ses', 'pre', 'post', 'aligned', 'session') and not regexp_full_match(x, '[a-z]*[0-9]+')))) as w from part),
f as (select p_brand, arg_min(w, p_partkey) as w from w group by p_brand)
select p_partkey, case when len(w.w) = 0 or len(f.w) = 0 then 0 else len(list_intersect(w.w, f.w)) end::bigint as score from w join f using (p_brand)""")
def name_similarity(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", N.tokens(F.concat_ws(" ", "p_name", "p_type")).alias("w"))
    f = p.groupBy("p_brand").agg(F.min_by("w", "p_partkey").alias("v"))
    return p.join(f, "p_brand").select("p_partkey", N.similarity(F.col("w"), F.col("v")).cast("long").alias("score"))


@query(r"""select page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'run') as name, regexp_replace(url || '_' || 'pre', '[^A-Za-z0-9_-]', '_', 'g') as tag from pages""")
def sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", N.sanitized(F.col("url")).alias("name"), N.file_tag(F.col("url"), F.lit("pre")).alias("tag"))


@query("""with n as (select c_custkey, 'sub-' || c_custkey || case c_custkey % 3 when 0 then '/ses-pre' when 1 then '/ses-post' else '/ses-7' end as s from customer)
select c_custkey, case c_custkey % 3 when 0 then 'pre' when 1 then 'post' else '7' end as phase, case c_custkey % 3 when 0 then 0 when 1 then 1 else 2 end as phase_order from n""")
def phase_label(spark, d):
    key = F.col("c_custkey")
    s = F.concat(F.lit("sub-"), key.cast("string"), F.when(key % 3 == 0, "/ses-pre").when(key % 3 == 1, "/ses-post").otherwise("/ses-7"))
    return table(spark, d, "customer").select("c_custkey", N.phase(s).alias("phase"), N.phase_order(N.phase(s)).alias("phase_order"))


@query("""select c_custkey, 'sub' || c_custkey || '_ses_' || case c_custkey % 2 when 0 then 'dx' else 'sx' end as prepost_key, 'sub' || c_custkey || '_sespre' as side_key, case c_custkey % 2 when 0 then 'dx' else 'sx' end as side from customer""")
def pair_keys(spark, d):
    key = F.col("c_custkey")
    n = F.concat(F.lit("sub"), key.cast("string"), F.lit("_sespre_"), F.when(key % 2 == 0, "dx").otherwise("sx"))
    return table(spark, d, "customer").select("c_custkey", N.prepost_key(n).alias("prepost_key"), N.side_key(n).alias("side_key"), N.side_of_name(n).alias("side"))


RUN_NAME_SQL = """n as (select c_custkey, 'sub-' || c_custkey || case c_custkey % 4 when 0 then '_reach_dx' when 1 then '_rest_sin' when 2 then '_motor' else '_reachSX_mvc' end as pair, case c_custkey % 3 when 0 then 'pre' when 1 then 'POST' else '' end as phase from customer)"""


def run_names(spark, d):
    key = F.col("c_custkey")
    pair = F.concat(F.lit("sub-"), key.cast("string"), F.when(key % 4 == 0, "_reach_dx").when(key % 4 == 1, "_rest_sin").when(key % 4 == 2, "_motor").otherwise("_reachSX_mvc"))
    return table(spark, d, "customer").select("c_custkey", pair.alias("pair"), F.when(key % 3 == 0, "pre").when(key % 3 == 1, "POST").otherwise("").alias("phase"))


@query("with " + RUN_NAME_SQL + """ select c_custkey, c_custkey % 4 in (0, 2) as movement, upper(c_custkey::varchar) || case c_custkey % 4 when 0 then ' dx' when 1 then ' sx' when 3 then ' sx' else '' end || ' ' || phase as label, c_custkey::double as subject_order from n""")
def run_labels(spark, d):
    n = run_names(spark, d)
    return n.select("c_custkey", N.is_movement(F.col("pair"), F.col("phase")).alias("movement"), N.short_label(F.col("pair"), F.col("phase")).alias("label"), N.subject_order(F.col("pair")).alias("subject_order"))


@query("with " + RUN_NAME_SQL + """ select c_custkey, array_to_string(list_filter(['sub', case when c_custkey >= 10 then c_custkey::varchar end, case c_custkey % 4 when 0 then 'reach' when 1 then 'rest' when 2 then 'motor' else 'reachsx' end, case c_custkey % 4 when 0 then 'dx' when 1 then 'sin' when 3 then 'mvc' end, nullif(lower(phase), '')], lambda x: x is not null), ' ') as words,
case c_custkey % 4 when 0 then 'dx' when 1 then 'sx' when 3 then 'sx' else '' end as side, case c_custkey % 4 when 0 then true when 1 then false when 3 then false else true end as fits from n""")
def pair_words(spark, d):
    n = run_names(spark, d)
    side = N.pair_side(F.col("pair"))
    return n.select("c_custkey", F.array_join(N.pair_tokens(F.col("pair"), F.col("phase")), " ").alias("words"), side.alias("side"), N.side_compatible(side, F.lit("/x/right/a.mat")).alias("fits"))


@query("""with f as (select row_number() over (order by n_nationkey) - 1 as ord, '/data/' || lower(replace(n_name, ' ', '_')) || '/' || case n_nationkey % 2 when 0 then 'dx' else 'sx' end || '/sources.mat' as path, n_name, n_nationkey from nation),
r as (select c_custkey, 'sub_' || lower(replace(n_name, ' ', '_')) || case c_custkey % 2 when 0 then '_dx' else '_sx' end as pair, case when c_custkey % 10 = 0 then 'given.mat' end as given, case when c_custkey % 10 = 1 then 'local.mat' end as local, c_custkey % 2 as odd from customer join nation on c_nationkey = n_nationkey),
w as (select *, list_filter(string_split(pair, '_'), lambda x: len(x) >= 2 and x not in ('bids', 'ses', 'session', 'pair', 'pre', 'post')) || ['pre'] as words from r),
s as (select w.*, f.path, f.ord, case when f.path like '%' || case odd when 0 then 'dx' else 'sx' end || '%' or f.path like case odd when 0 then '%destra%' else '%sin%' end or f.path like case odd when 0 then '%right%' else '%left%' end then len(list_filter(words, lambda x: contains(f.path, x))) else 0 end as score from w, f),
b as (select c_custkey, any_value(given) as given, any_value(local) as local, max(score) as best, arg_max(path, (score, -ord)) as path from s group by c_custkey)
select c_custkey, coalesce(given, local, case when best >= 2 then path end) as source, case when given is not null then 'from_report' when local is not null then 'local_match' when best >= 2 then 'indexed_match_' || best else 'indexed_not_matched' end as status from b""")
def source_of_runs(spark, d):
    low = F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("_")))
    n = table(spark, d, "nation")
    files = n.select((F.row_number().over(Window.orderBy("n_nationkey")) - 1).alias("ord"), F.concat(F.lit("/data/"), low, F.when(F.col("n_nationkey") % 2 == 0, "/dx").otherwise("/sx"), F.lit("/sources.mat")).alias("path"))
    key = F.col("c_custkey")
    runs = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("sub_"), low, F.when(key % 2 == 0, "_dx").otherwise("_sx")).alias("pair"), F.lit("pre").alias("phase"), F.when(key % 10 == 0, "given.mat").alias("given"), F.when(key % 10 == 1, "local.mat").alias("local"))
    return recordings.source_of_runs(runs, files).select("c_custkey", "source", "status")


@query("""with n as (select s_suppkey, 'out/sub' || s_suppkey || '/pre/report.json' as path, case s_suppkey % 3 when 0 then s_acctbal::varchar when 1 then 'n/a' else '' end as text from supplier)
select s_suppkey, 'sub' || s_suppkey as pair, 'pre' as phase, round(try_cast(text as double), 4) as number, case when s_suppkey % 2 = 0 then '1' else '0' end as flag, coalesce(printf('%.0f', round(try_cast(text as double))), '') as whole from n""")
def text_numbers(spark, d):
    key = F.col("s_suppkey")
    n = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("out/sub"), key.cast("string"), F.lit("/pre/report.json")).alias("path"), F.when(key % 3 == 0, F.col("s_acctbal").cast("string")).when(key % 3 == 1, "n/a").otherwise("").alias("text"))
    pair, phase = N.report_place(F.col("path"))
    return rounded(n.select("s_suppkey", pair.alias("pair"), phase.alias("phase"), X.number(F.col("text")).alias("number"), X.flag(key % 2 == 0).alias("flag"), X.fixed(X.whole(X.number(F.col("text"))), 0, "").alias("whole")), 4)


@query("select event_id, epoch_us(ts) as us, strftime(ts + interval 5 hour + interval 30 minute, '%Y-%m-%dT%H:%M:%S.%f') || '+05:30' as iso from events")
def iso_epoch_roundtrip(spark, d):
    df = table(spark, d, "events")
    iso = T.iso_text(T.micros(df, "ts"), F.lit("+05:30"))
    return df.select("event_id", iso.alias("iso")).select("event_id", T.iso_micros(F.col("iso")).alias("us"), "iso")


@query("select event_id, coalesce(json_extract_string(props, '$.k'), 'none') as k, coalesce(json_extract_string(props, '$.other'), 'none') as other from events")
def json_field_default(spark, d):
    get = lambda f: F.coalesce(F.get_json_object("props", f"$.{f}"), F.lit("none")).alias(f)
    return table(spark, d, "events").select("event_id", get("k"), get("other"))


@query("select l_returnflag, round(quantile_cont(l_quantity, 0.95), 6) as p95, round(quantile_cont(l_extendedprice, 0.95), 6) as p95_price from lineitem group by l_returnflag")
def p95_n1(spark, d):
    li = table(spark, d, "lineitem")
    of = lambda c, name: reports.quantiles(li, ["l_returnflag"], c, {name: 0.95})
    return rounded(reports.same_keys(of("l_quantity", "p95"), of("l_extendedprice", "p95_price"), ["l_returnflag"]))


@query("with " + E_SQL + """, r as (select run, value, row_number() over (partition by run order by value) as r, count(*) over (partition by run) as n from e where value is not null),
p as (select run, n, least(greatest(0.7 * n + 0.5, 1), n) as pl from r group by run, n)
select p.run, round(max(value) filter (r = floor(pl)) + (max(value) filter (r = least(floor(pl) + 1, r.n)) - max(value) filter (r = floor(pl))) * (any_value(pl) - floor(any_value(pl))), 6) as p70 from p join r using (run) group by p.run""")
def p70_mid(spark, d):
    return rounded(reports.quantiles(events(spark, d), ["run"], "value", {"p70": 0.7}, "mid"))


@query("""with q as (select l_suppkey, quantile_cont(l_quantity / 30, 0.25) as q1, quantile_cont(l_quantity / 30, 0.5) as q2, quantile_cont(l_quantity / 30, 0.75) as q3 from lineitem group by l_suppkey)
select l_orderkey, l_linenumber, case when l_quantity / 30 < 0.75 then 'short' when l_quantity / 30 <= 1.25 then 'mid' else 'long' end as duration_class, l_quantity / 30 <= q1 as is_short, l_quantity / 30 >= q3 as is_long, round(q2, 6) as q2 from lineitem join q using (l_suppkey)""")
def trial_table(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_quantity") / 30).alias("dur"))
    return rounded(reports.trial_table(li, ["l_suppkey"], "dur").select("l_orderkey", "l_linenumber", "duration_class", "is_short", "is_long", "q2"))


@query("with " + E_SQL + " select run, round(avg(value), 6) as mean, max(value) as largest, min(value) as least_, round(stddev_samp(value) / greatest(avg(value), 2.220446049250313e-16), 6) as cv from e group by run")
def mean_finite(spark, d):
    v = F.col("value")
    return rounded(events(spark, d).groupBy("run").agg(X.mean_finite(v).alias("mean"), X.max_finite(v).alias("largest"), X.min_finite(v).alias("least_"), X.variation(v).alias("cv")))


STATE_SQL = E_SQL + """, r as (select run, ord, value, row_number() over (partition by run order by value) as r, count(*) over (partition by run) as n from e where value is not null),
p as (select run, n, least(greatest(0.7 * n + 0.5, 1), n) as pl from r group by run, n),
l as (select p.run, max(value) filter (r = floor(pl)) + (max(value) filter (r = least(floor(pl) + 1, r.n)) - max(value) filter (r = floor(pl))) * (any_value(pl) - floor(any_value(pl))) as level from p join r using (run) group by p.run)"""


@query("with " + STATE_SQL + """, s as (select e.run, count(value) as n, case when count(value) >= 6 then count(*) filter (value >= level) else 0 end as na, avg(ord) filter (value >= level) as act, avg(ord) filter (value < level) as inact from e join l using (run) group by e.run),
m as (select *, na >= 3 and n - na >= 3 as enough from s)
select run, n, na as n_active, round(case when enough then act end, 6) as active, round(case when enough then inact end, 6) as rest, round(case when enough then act - inact end, 6) as delta, round(case when enough and abs(inact) > 2.220446049250313e-16 then act / inact end, 6) as ratio from m""")
def state_dependent(spark, d):
    e = events(spark, d).withColumn("y", F.col("ord").cast("double"))
    return rounded(reports.split_by_state(e, ["run"], "value", "y").select("run", "n", "n_active", "active", "rest", "delta", "ratio"))


@query("with " + E_SQL + """, r as (select code, ord, value / 400 as p, row_number() over (partition by code order by value / 400, ord) as rk, count(*) over (partition by code) as m from e)
select code, ord, round(least(1.0, min(p * m / rk) over (partition by code order by rk desc rows unbounded preceding)) + 1e-9, 6) as q from r""")
def bh_fdr(spark, d):
    out = reports.false_discovery(events(spark, d).select("code", "ord", (F.col("value") / 400).alias("p")), ["code"], "p")
    return out.select("code", "ord", F.round(F.col("q") + 1e-9, 6).alias("q"))


@query("with " + E_SQL + ", o as (select code, avg(value) as obs from e group by code) select code, round((1 + count(*) filter (value >= obs)) / (count(*) + 1.0), 9) as p from e join o using (code) group by code")
def empirical_p(spark, d):
    e = events(spark, d)
    own = e.join(e.groupBy("code").agg(F.avg("value").alias("obs")), "code")
    return own.groupBy("code", "obs").agg(F.round(X.empirical_p(F.col("value"), F.col("obs")), 9).alias("p")).drop("obs")


@query("with " + E_SQL + " select ord, round(atanh(sqrt(least(greatest(value / 500, 0), 1 - 1e-9))), 6) as z from e")
def fisher_z(spark, d):
    return rounded(events(spark, d).select("ord", X.fisher_z(F.col("value") / 500).alias("z")))


@query("with " + E_SQL + " select code, round(atan2(avg(sin(value)), avg(cos(value))), 6) as phase from e group by code")
def circular_mean(spark, d):
    return rounded(events(spark, d).groupBy("code").agg(X.circular_mean(F.col("value")).alias("phase")))


CURVE_SQL = E_SQL + """, p as (select run, row_number() over (partition by run order by t, ord) - 1 as i, least(value / 500, 1) as c, value / 100 as ph from e),
q as (select *, i * 0.5 as f from p), b as (select *, lead(f) over w as f1, lead(c) over w as c1, lead(ph) over w as ph1 from q where f between 13 and 30 window w as (partition by run order by f))"""


def curve(spark, d):
    e = events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("run").orderBy("t", "ord")) - 1)
    c, ph = F.least(F.col("value") / 500, F.lit(1.0)), F.col("value") / 100
    return e.select("run", "i", (F.col("i") * 0.5).alias("f"), c.alias("c"), ph.alias("angle"), (F.sqrt(c) * F.cos(ph)).alias("re"), (F.sqrt(c) * F.sin(ph)).alias("im"))


@query("with " + CURVE_SQL + """ select run, round(avg(c), 6) as beta_mean, round(max(c), 6) as beta_peak, arg_max(f, (c, -f)) as beta_peak_hz, round(sum((f1 - f) * (c + c1) / 2), 6) as beta_auc,
round(avg(atanh(sqrt(least(greatest(c, 0), 1 - 1e-9)))), 6) as z_mean, round(atan2(avg(sin(ph)), avg(cos(ph))), 6) as angle, round(sum(sqrt(c * c1) * sin(ph1 - ph)), 6) as psi from b group by run""")
def band_metrics(spark, d):
    return rounded(coupling.band_metrics(curve(spark, d), ["run"]))


@query("with " + E_SQL + ", p as (select run, value, row_number() over (partition by run order by t, ord) as i, count(*) over (partition by run) as n from e) select run, round(avg(value) filter (i > floor(n * 2 / 3)) - avg(value) filter (i <= floor(n / 3)), 6) as late_early from p group by run")
def thirds_delta(spark, d):
    w = Window.partitionBy("run")
    e = events(spark, d).withColumns({"i": F.row_number().over(w.orderBy("t", "ord")), "n": F.count("*").over(w)}).withColumn("part", X.third(F.col("i"), F.col("n")))
    mean = lambda k: F.avg(F.when(F.col("part") == k, F.col("value")))
    return rounded(e.groupBy("run").agg((mean(3) - mean(1)).alias("late_early")))


@query("""with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as a, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 as b from lineitem)
select l_returnflag, count(*) as n, round(corr(a, b), 8) as rho from r group by l_returnflag""")
def spearman_cov(spark, d):
    out = reports.spearman(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "n", F.round("rho", 8).alias("rho"))


MEAN_SQL = "x as (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), m as (select label, i, avg(v) as v from x group by label, i)"


def label_means(spark, d):
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("p"))


@query("with " + MEAN_SQL + """, c as (select label, i, v - avg(v) over (partition by label) as v from m), n as (select label, sqrt(sum(v * v)) as s from c group by label),
u as (select c.label, i, v / greatest(s, 2.220446049250313e-16) as v from c join n using (label))
select a.label as a, b.label as b, round(case when a.label = b.label then 0 else greatest(1 - sum(a.v * b.v), 0) end, 6) as distance from u a join u b using (i) group by a.label, b.label""")
def corr_distance(spark, d):
    return rounded(coupling.profile_distance(label_means(spark, d), [], "label", "p"))


@query("with " + MEAN_SQL + " select label, i, round(v, 6) as v from m")
def roi_mean(spark, d):
    return rounded(label_means(spark, d).select("label", F.posexplode("p").alias("i", "v")).withColumn("i", F.col("i").cast("long")))


@query("""with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings),
t as (select label as name, avg(embedding[1]::double) as x, avg(embedding[2]::double) as y, avg(embedding[3]::double) as z from embeddings group by label), r as (select t.name, p.vec_id as point, (p.x - t.x) ** 2 + (p.y - t.y) ** 2 + (p.z - t.z) ** 2 as d from p, t),
k as (select *, row_number() over (partition by name order by d, point) as rank from r) select name, point, rank, round(d, 6) as distance2 from k where rank <= 25""")
def knn25(spark, d):
    e = table(spark, d, "embeddings")
    p = e.select(F.col("vec_id").alias("point"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    places = e.groupBy(F.col("label").alias("name")).agg(*[F.avg(F.col("embedding")[k].cast("double")).alias(c) for k, c in enumerate("xyz")])
    out = signals.nearest(p, places, 25)  # the labels' mean places, a short list
    return rounded(out.select("name", "point", F.col("rank").cast("long").alias("rank"), "distance2"))


@query("with " + MEAN_SQL + ", s as (select label, i, sum((x.v - m.v) ** 2) as e, sum(x.v ** 2) as q from x join m using (label, i) group by label, i) select label, round(1 - sum(e) / sum(q), 6) as vaf, round(min(1 - e / q), 6) as vaf_min from s group by label")
def vaf(spark, d):
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    m = x.groupBy("label", "i").agg(F.avg("v").alias("y"))
    return rounded(synergies.accounted_for(x.join(m, ["label", "i"]), ["label"], "i", "v", "y"))


@query("""with m as (select l_suppkey, avg(l_quantity) as mean, avg(l_quantity) filter (l_returnflag = 'A') as a, avg(l_quantity) filter (l_returnflag = 'N') as n, avg(l_quantity) filter (l_returnflag = 'R') as r from lineitem group by l_suppkey)
select l_suppkey, row_number() over (order by mean desc nulls first, l_suppkey) as rank, round(mean, 6) as mean, round(a, 6) as syn_A, round(n, 6) as syn_N, round(r, 6) as syn_R from m""")
def rank_pivot(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    out = reports.ranked_pivot(li, "l_suppkey", "l_returnflag", "l_quantity", ["A", "N", "R"], "syn_")
    return rounded(out.withColumn("rank", F.col("rank").cast("long")))


@query("select coalesce(l_shipmode_, 'all') as flag, n, round(mean, 6) as mean, largest from (select l_returnflag as l_shipmode_, count(l_quantity) as n, avg(l_quantity) as mean, max(l_quantity) as largest from lineitem group by grouping sets ((l_returnflag), ()))")
def total_plus_detail(spark, d):
    out = reports.total_and_detail(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return rounded(out.select(F.col("l_returnflag").alias("flag"), "n", "mean", F.col("max").alias("largest")))


@query("select n_name, printf('%.3f-%.3f', min(c_acctbal), max(c_acctbal)) as balance, printf('%.2f', avg(c_acctbal)) as mean from customer join nation on c_nationkey = n_nationkey group by n_name")
def minmax_range(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    b = F.col("c_acctbal")
    return c.groupBy("n_name").agg(X.number_range(X.min_finite(b), X.max_finite(b), 3).alias("balance"), X.fixed(F.avg(b), 2).alias("mean"))


FINAL_SQL = """t as (select 'sub' || l_suppkey || case l_suppkey % 2 when 0 then '_dx' else '_sx' end as pair, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice from lineitem),
m as (select l_suppkey, min(l_discount) as b0, max(l_discount) as b1, min(l_tax) as p0, max(l_tax) as p1, min(l_quantity) as h0, max(l_quantity) as h1, min(l_discount + l_tax) as z0, max(l_discount + l_tax) as z1, min(l_tax * l_tax) as k0, max(l_tax * l_tax) as k1, min(l_extendedprice) / 1e6 as q, avg(l_quantity) filter (l_quantity > 0) as n, avg(l_extendedprice) filter (l_extendedprice > 0) / 1000 as s, count(*) as c from t group by l_suppkey)"""


@query("with " + FINAL_SQL + """ select l_suppkey || case l_suppkey % 2 when 0 then ' dx pre' else ' sx pre' end as "Run", 'pre' as "Phase", c::varchar as "Trials", printf('%.1f', n) as "Mean samples", printf('%.3f', s) as "Mean sec", '4' as "Synergies", '0.925' as "VAF", printf('%.4f', q) as "FDR q min",
printf('%.3f-%.3f', b0, b1) as "Beta mean", printf('%.3f-%.3f', p0, p1) as "Beta peak", printf('%.2f-%.2f', h0, h1) as "Beta Peak Hz", printf('%.3f-%.3f', z0, z1) as "zCoh mean", printf('%.3f-%.3f', k0, k1) as "zCoh peak", l_suppkey::double as subject_order, 0 as phase_order, case l_suppkey % 2 when 0 then 1 else 2 end as side_order from m where l_suppkey % 3 = 0""")
def final_table(spark, d):
    li = table(spark, d, "lineitem")
    key = F.col("l_suppkey")
    own = li.withColumns({"pair": F.concat(F.lit("sub"), key.cast("string"), F.when(key % 2 == 0, "_dx").otherwise("_sx")), "phase": F.lit("pre")})
    runs = own.groupBy("pair", "phase", "l_suppkey").agg(F.count("*").alias("n_trials")).withColumns({"status": F.lit(" OK"), "eeg_mode": F.when(key % 3 == 0, "source_net").otherwise("scalp"), "n_synergies": F.lit(4), "vaf": F.lit(0.925)})
    real = lambda c: F.col(c).cast("double")
    metrics = own.select("pair", "phase", real("l_discount").alias("beta_mean"), real("l_tax").alias("beta_peak"), real("l_quantity").alias("beta_peak_hz"), (F.col("l_discount") + F.col("l_tax")).cast("double").alias("z_mean"), (F.col("l_tax") * F.col("l_tax")).cast("double").alias("z_peak"), (real("l_extendedprice") / 1e6).alias("q"))
    cuts = own.select("pair", "phase", real("l_quantity").alias("n_samples"), (real("l_extendedprice") / 1000).alias("duration_s"))
    return reports.final_table(runs, metrics, cuts, ["pair", "phase"])


@query("select o_custkey, round(avg(o_totalprice), 6) as beta_mean_all, max(o_totalprice) as beta_peak_all, round(avg(o_orderkey % 7), 6) as beta_auc_all, min(o_totalprice) as p_min, min(o_orderkey)::double as q_min, count(*) filter (o_orderstatus = 'F') as n_significant from orders group by o_custkey")
def metric_totals(spark, d):
    o = table(spark, d, "orders")
    m = o.select("o_custkey", F.col("o_totalprice").cast("double").alias("beta_mean"), F.col("o_totalprice").cast("double").alias("beta_peak"), (F.col("o_orderkey") % 7).alias("beta_auc"), F.col("o_totalprice").cast("double").alias("p"), F.col("o_orderkey").cast("double").alias("q"), (F.col("o_orderstatus") == "F").alias("significant"))
    return rounded(coupling.metric_totals(m, ["o_custkey"]))


@query("with " + MEAN_SQL + ", r as (select * from (values ('odd', '1'), ('odd', '3'), ('odd', '5'), ('low', '0'), ('low', '1')) as r(roi, label)) select roi, i, round(avg(v), 6) as x, count(*) as n from m join r on m.label::varchar = r.label group by roi, i")
def region_means(spark, d):
    own = label_means(spark, d).select(F.lit(1).alias("run"), F.col("label").cast("string").alias("ch"), F.col("p").alias("samples"))
    regions = spark.createDataFrame([("odd", ["1", "3", "5"]), ("low", ["0", "1"])], "name string, labels array<string>")
    out = signals.region_means(own, regions, ["run"]).select("roi", F.posexplode("samples").alias("i", "x"), F.col("n_channels").alias("n"))
    return rounded(out.withColumn("i", F.col("i").cast("long")))


@query("with " + MEAN_SQL + """, p as (select label::varchar as ch, max(v) filter (i = 0) as x, max(v) filter (i = 1) as y, max(v) filter (i = 2) as z from m group by label),
d as (select a.ch, b.ch as mirror, abs(a.y) > 1e-6 and sign(a.y) * sign(b.y) < 0 as opposite, (a.x - b.x) ** 2 + (a.y + b.y) ** 2 + (a.z - b.z) ** 2 as d from p a, p b where a.ch <> b.ch),
k as (select *, bool_or(opposite) over (partition by ch) as any_opposite from d), c as (select ch, mirror, row_number() over (partition by ch order by d, mirror) as r from k where opposite or not any_opposite)
select p.ch, coalesce(c.mirror, p.ch) as mirror from p left join c on c.ch = p.ch and r = 1""")
def mirrored_channels(spark, d):
    at = lambda k: F.get("p", F.lit(k))
    return signals.mirrored(label_means(spark, d).select(F.col("label").cast("string").alias("ch"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z")))


SLICE_SQL = E_SQL + """, v as (select run, list(value order by t, ord) as v, max(value) as top from e group by run), s as (select run, unnest([{'trial': 1, 'i1': 1, 'i2': 5}, {'trial': 2, 'i1': 4, 'i2': 9}, {'trial': 3, 'i1': 8, 'i2': 200}]) as s from v),
c as (select run, s.trial as trial, list_slice(v, s.i1, s.i2) as x, top from s join v using (run)), k as (select * from c where len(x) >= 4 and not list_contains(list_transform(x, lambda y: y is null), true))"""


def sliced(spark, d):
    spans = spark.createDataFrame([(1, 1, 5), (2, 4, 9), (3, 8, 200)], "trial int, i1 int, i2 int")
    own = run_signals(spark, d).select("run", F.lit("c").alias("ch"), "samples")
    return trials.cut_samples(own, own.select("run").distinct().crossJoin(F.broadcast(spans)), ["run"], 4)


@query("with " + SLICE_SQL + " select run, trial, len(x) as n, round(list_sum(x), 6) as total from k")
def trial_slices(spark, d):
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return rounded(sliced(spark, d).select("run", "trial", F.size("samples").cast("long").alias("n"), total.alias("total")))


@query("with " + SLICE_SQL + ", j as (select run, flatten(list(x order by trial)) as x from k group by run) select run, len(x) as n, round(x[len(x)], 6) as last, round(x[1], 6) as first from j")
def joined_slices(spark, d):
    own = trials.join_samples(sliced(spark, d), ["run"])
    return rounded(own.select("run", F.size("samples").cast("long").alias("n"), F.element_at("samples", -1).alias("last"), F.element_at("samples", 1).alias("first")))


@query("with " + SLICE_SQL + ", p as (select run, trial, least(len(x), 5) as n, x from k where least(len(x), 5) >= 4) select run, trial, n, round(list_sum(x[1:n]), 6) as eeg, round(list_sum(list_transform(x[1:n], lambda y: y * 2)), 6) as emg from p")
def paired_slices(spark, d):
    a = sliced(spark, d)
    b = a.withColumn("samples", F.transform(F.slice("samples", 1, 5), lambda x: x * 2))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return rounded(trials.paired_trials(a, b, ["run"], 4).select("run", "trial", F.size("eeg").cast("long").alias("n"), total("eeg").alias("eeg"), total("emg").alias("emg")))


@query("with " + E_SQL + " select ord, case when code in ('DIN1', 'DIN4', 'DIN5') then 'OTB_trigger' else 'OTB_reconstructed' end as Event_type, code as name, printf('%.6f', t) as time, '0.001' as duration, '0' as \"Offset\" from e")
def event_rows(spark, d):
    e = events(spark, d)
    return e.select("ord", *[c.alias(n) for n, c in sinks.event_columns().items()])


def run_signals(spark, d):
    """run, fs, samples: each run's values in order, as a signal."""
    e = events(spark, d)
    s = F.transform(F.array_sort(F.collect_list(F.struct("t", "ord", "value"))), lambda x: x["value"])
    return e.groupBy("run").agg(F.lit(1000.0).alias("fs"), s.alias("samples"))


@query()
def emg_envelope(spark, d):
    e = reports.running_sums(events(spark, d).select("run", "t", "ord", "value"), ["run"], ["t", "ord"], F.lit(1)).withColumn("at", F.col("upto_") - 1)
    block = F.expr("at div 4096")
    rows = e.groupBy("run", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("own"))  # 4096 samples
    blocks = rows.select("run", (F.col("block") * 4096).alias("start"), F.col("own.value").alias("samples"))
    out = signals.long_envelopes(blocks, ["run"], 1000.0)
    return out.select("run", "start", F.posexplode("samples").alias("i", "x")).select("run", (F.col("start") + F.col("i")).alias("i"), "x")


@query("with " + E_SQL + ", v as (select run, list(value order by t, ord) as v from e group by run), g as (select run, v, unnest(range(0, greatest(1, floor(len(v) * 0.25 + 0.5))::bigint)) as i from v) select run, i, round(v[least(4 * i, len(v) - 1) + 1], 6) as x from g")
def resample_signal(spark, d):
    out = signals.resampled(run_signals(spark, d), 250.0).select("run", F.posexplode("samples").alias("i", "x"))
    return rounded(out.withColumn("i", F.col("i").cast("long")))


def label_pairs(spark, d):
    """label, e, h: two long signals of each label."""
    e = table(spark, d, "embeddings").withColumn("half", F.col("vec_id") % 2)
    s = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("half") == 0, F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v"))))), lambda x: x["v"]))
    h = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("half") == 1, F.struct("vec_id", F.col("embedding").cast("array<double>").alias("v"))))), lambda x: x["v"]))
    return e.groupBy("label").agg(s.alias("e"), h.alias("h"))


@query()
def welch_coherence(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", (F.col("vec_id") % 2).alias("half"), F.col("embedding").cast("array<double>").alias("v"))
    placed = reports.running_sums(e, ["label", "half"], ["vec_id"], F.size("v")).withColumn("start", F.col("upto_") - F.size("v"))
    of = lambda half, name: placed.where(F.col("half") == half).select("label", "start", F.col("v").alias(name))
    blocks = of(0, "e").join(of(1, "h"), ["label", "start"])  # as long as the shorter signal
    return signals.long_coherence(blocks, ["label"], 250.0).select("label", "n_segments", F.posexplode("c").alias("i", "c"))


@query()
def surrogate_test(spark, d):
    stats = coupling.trial_statistics(label_pairs(spark, d), ["label"], 250.0).withColumn("all", F.lit(1))
    return coupling.surrogate_test(stats, ["all", "label"], ["all"])


@query()
def bootstrap_ci(spark, d):
    return coupling.bootstrap_mean(events(spark, d), ["run"], "value")


@query()
def muscle_synergies(spark, d):
    own = fit.numbered(table(spark, d, "embeddings"), ["label"], ["vec_id"])
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    cuts = own.select("label", (F.col("k") % 4).cast("string").alias("ch"), F.floor(F.col("k") / 4).alias("trial"), v.alias("samples"))
    return synergies.synergies(cuts, ["label"]).select("label", "syn", "n_syn", "vaf", "vaf_min", "stability", "trial")


@query()
def canonical_correlation(spark, d):
    e = table(spark, d, "embeddings").select("label", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    return coupling.canonical(e, ["label"], "x", "y")


@query()
def profile_clusters(spark, d):
    return coupling.profile_clusters(label_means(spark, d).withColumn("all", F.lit(1)), ["all"], "label", "p")


@query("with " + MEAN_SQL + """, k as (select label + 1 as j, i + 1 as ch, v from m),
p as (select a.label + 1 as i, b.label + 1 as j, sum(a.v * b.v) as v from m a join m b using (i) group by all),
e as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding[4]::double > 0 as inside, embedding from embeddings),
s as (select vec_id as voxel, unnest(range(1, 11)) as i, unnest(embedding[1:10])::double as v from e),
t as (select label as roi, max(v) filter (i = 0) as x, max(v) filter (i = 1) as y, max(v) filter (i = 2) as z from m group by label),
n as (select roi, vec_id as voxel, row_number() over (partition by roi order by (e.x - t.x) ** 2 + (e.y - t.y) ** 2 + (e.z - t.z) ** 2, vec_id) as r from e, t where inside),
w as (select roi, i, avg(v) as v from n join s using (voxel) where r <= 25 group by roi, i),
wp as (select roi, j, sum(w.v * p.v) as v from w join p using (i) group by roi, j),
f as (select roi, ch, sum(wp.v * k.v) as v from wp join k using (j) group by roi, ch),
cells as (select vec_id as t, unnest(range(1, 65)) as ch, unnest(embedding)::double as v from embeddings),
g as (select roi, t, sum(f.v * c.v) as v from f join cells c using (ch) group by roi, t),
q as (select roi, avg(v) as mean, stddev_samp(v) as sd from g group by roi)
select roi, t, round((v - mean) / sd, 6) as v from g join q using (roi)""")
def source_projection(spark, d):
    """Every vector is a moment of 64 sensors and a voxel; kernel and projection are the labels' means and their products."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    run = F.lit("all").alias("run")
    m = label_means(spark, d).select("label", "p")
    kernel = m.select(run, (F.col("label") + 1).alias("j"), F.posexplode("p").alias("ch", "v")).withColumn("ch", F.col("ch") + 1)
    long = m.select("label", F.posexplode("p").alias("k", "v"))
    both = long.select(F.col("label").alias("i"), "k", F.col("v").alias("a")).join(long.select(F.col("label").alias("j"), "k", F.col("v").alias("b")), "k")
    proj = both.groupBy((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j")).agg(F.sum(F.col("a") * F.col("b")).alias("v")).select(run, "i", "j", "v")
    voxels = e.select(run, F.col("vec_id").alias("voxel"), *[F.col("v")[k].alias(c) for k, c in enumerate("xyz")], (F.col("v")[3] > 0).alias("inside"))
    spatial = e.select(run, F.col("vec_id").alias("voxel"), F.posexplode(F.slice("v", 1, 10)).alias("i", "w")).select("run", "voxel", (F.col("i") + 1).cast("long").alias("i"), F.col("w").alias("v"))
    regions = m.select(F.col("label").alias("name"), *[F.get("p", F.lit(k)).alias(c) for k, c in enumerate("xyz")])
    block = F.expr("vec_id div 256")
    cells = e.select(block.alias("block"), F.posexplode("v").alias("ch", "x"), "vec_id")
    rows = cells.groupBy("block", (F.col("ch") + 1).alias("ch")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("own"))  # 256 moments
    sensors = rows.select(run, "ch", "block", F.col("own.x").alias("samples"))
    out, _ = projection.source_regions(sensors, voxels, spatial, proj, kernel, regions, ["run"])
    times = rows.where("ch = 1").select("block", F.col("own.vec_id").alias("times"))
    points = out.join(times, "block").select(F.col("roi"), F.explode(F.arrays_zip("times", "samples")).alias("p"))
    return rounded(points.select("roi", F.col("p.times").alias("t"), F.col("p.samples").alias("v")))


@query("""with e as (select label, row_number() over (partition by label order by vec_id) as trial, embedding from embeddings), x as (select label, trial, unnest(range(64)) as k, unnest(embedding)::double as v from e)
select label, trial, k // 16 + 1 as c, 'C' || (k // 16 + 1) as ch, 250.0::double as fs, k % 16 as t, round(v, 6) as v from x""")
def trial_tensors(spark, d):
    """A label's vectors as trials of 4 channels by 16 times, each label's block with its axes in another order."""
    e = fit.numbered(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), ["label"], ["vec_id"])
    cells = e.select("label", (F.col("k") - 1).alias("trial"), F.posexplode("embedding").alias("p", "v")).withColumns({"c": F.expr("p div 16"), "t": F.expr("p % 16")})
    n = cells.groupBy("label").agg((F.max("trial") + 1).cast("int").alias("n"))
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]  # which of trial, channel, time is each axis
    pick = lambda values: F.coalesce(*[F.when(F.pmod("label", F.lit(6)) == k, F.array(*[values[a] for a in o])) for k, o in enumerate(orders)])
    heads = n.select("label", pick([F.col("n"), F.lit(4), F.lit(16)]).alias("dims"), F.array(*[F.lit(f"C{k}") for k in range(1, 5)]).alias("labels"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda x: x * 4.0).alias("times"))
    at = cells.join(heads.select("label", "dims"), "label").withColumn("at", pick([F.col("trial").cast("long"), F.col("c").cast("long"), F.col("t").cast("long")]))
    flat = at.select("label", F.col("v").cast("double").alias("v"), (F.col("at")[0] + F.col("dims")[0] * (F.col("at")[1] + F.col("dims")[1] * F.col("at")[2])).alias("flat"))
    blocks = flat.groupBy("label", F.expr("flat div 500").alias("b")).agg(F.array_sort(F.collect_list(F.struct("flat", "v"))).alias("own")).select("label", (F.col("b") * 500).alias("start"), F.col("own.v").alias("values"))
    out = projection.trial_tensors(blocks, heads, ["label"])
    return rounded(out.select("label", "trial", "c", "ch", "fs", F.posexplode("samples").alias("t", "v")).withColumn("t", F.col("t").cast("long")))


@query("""with x as (select s_suppkey as k, '/net/' || lower(replace(n_name, ' ', '_')) || '_reach_' || case s_suppkey % 2 when 0 then 'dx' else 'sx' end || '_s' || s_suppkey || '.mff' as mff, s_suppkey || '.mat' as trials from supplier join nation on s_nationkey = n_nationkey),
n as (select count(*) as n from x),
r as (select c_custkey, lower(replace(n_name, ' ', '_')) || '_reach' as pair, case when c_custkey % 11 = 0 then 'given.mat' end as given, case c_custkey % 4 when 0 then upper(x.mff) when 1 then '/else/' || split_part(x.mff, '/', 3) when 2 then '/else/' || lower(replace(n_name, ' ', '_')) || '_reach_dx_s' end as mff
  from customer join nation on c_nationkey = n_nationkey, n join x on x.k = c_custkey % n.n + 1),
w as (select *, list_filter(string_split(pair, '_'), lambda y: len(y) >= 2 and y not in ('bids', 'ses', 'session', 'pair', 'pre', 'post')) || ['pre'] as words, split_part(mff, '/', 3) as base from r),
s as (select w.c_custkey, x.k, x.trials, lower(w.mff) = x.mff as same, case when contains(x.mff, lower(base)) then 10 else 0 end + len(list_filter(words, lambda y: contains(x.mff, y))) as score from w, x where w.mff is not null),
b as (select c_custkey, max(trials) filter (same) as exact, max(score) as score, arg_max(trials, (score, -k)) as best from s group by c_custkey)
select c_custkey, coalesce(given, exact, case when score >= 10 then best end) as trials, case when given is not null then 'from_report' when exact is not null then 'mapped_by_mff' when score >= 10 then 'mapped_by_name_' || score else 'index_not_matched' end as status from r left join b using (c_custkey)""")
def trials_of_runs(spark, d):
    low = F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("_")))
    n = table(spark, d, "nation")
    own = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    mff = F.concat(F.lit("/net/"), low, F.lit("_reach_"), F.when(F.col("s_suppkey") % 2 == 0, "dx").otherwise("sx"), F.lit("_s"), F.col("s_suppkey").cast("string"), F.lit(".mff"))
    index = own.select(F.format_string("%012d", "s_suppkey").alias("ord"), mff.alias("key"), mff.alias("mff"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".mat")).alias("trials"), F.col("s_suppkey").alias("k"))
    some = index.join(F.broadcast(index.agg(F.count("*").alias("n")))).select("k", "n", F.col("mff").alias("theirs"))
    key = F.col("c_custkey")
    runs = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(key, low.alias("low")).join(F.broadcast(index.agg(F.count("*").alias("n_"))))
    runs = runs.withColumn("k", key % F.col("n_") + 1).join(some, "k")
    base = F.regexp_extract("theirs", "([^/]*)$", 1)
    name = F.when(key % 4 == 0, F.upper("theirs")).when(key % 4 == 1, F.concat(F.lit("/else/"), base)).when(key % 4 == 2, F.concat(F.lit("/else/"), F.col("low"), F.lit("_reach_dx_s")))
    runs = runs.select(key.alias("run"), F.concat(F.col("low"), F.lit("_reach")).alias("pair"), F.lit("pre").alias("phase"), F.when(key % 11 == 0, "given.mat").alias("given"), name.alias("mff"))
    return datasets.trials_of_runs(runs, index.drop("k")).select(F.col("run").alias("c_custkey"), "trials", "status")


@query("with " + MEAN_SQL + """, r as (select n_nationkey as run, case n_nationkey % 2 when 0 then 'sx' else 'dx' end as side from nation),
p as (select run, label::varchar as ch, max(v) filter (i = 0) as x, max(v) filter (i = 1) + run / 1000 as y, max(v) filter (i = 2) as z from m, r group by run, label),
d as (select a.run, a.ch, b.ch as mirror, abs(a.y) > 1e-6 and sign(a.y) * sign(b.y) < 0 as opposite, (a.x - b.x) ** 2 + (a.y + b.y) ** 2 + (a.z - b.z) ** 2 as d from p a join p b on a.run = b.run and a.ch <> b.ch),
k as (select *, bool_or(opposite) over (partition by run, ch) as any_opposite from d), c as (select run, ch, mirror, row_number() over (partition by run, ch order by d, mirror) as r from k where opposite or not any_opposite),
g as (select * from (values (1, 'fc5', 'fc6', -50), (2, 'fc1', 'fc2', -25), (3, 'fz', 'fz', 0), (4, 'cz', 'cz', 0), (5, 'c3', 'c4', -40), (6, 't7', 't8', -65), (7, 'cp5', 'cp6', -60), (8, 'cp1', 'cp2', -30)) as g(ord, name, other, x)),
t as (select r.run, g.ord, case when side = 'sx' then other else name end as name, case when side = 'sx' and name not in ('fz', 'cz') then -x else x end::double as x, (ord - 1)::varchar as a, (ord + 1)::varchar as b, side = 'sx' and name not in ('fz', 'cz') as turn from r, g)
select t.run, t.ord, t.name, t.x, case when turn then coalesce(ca.mirror, a) else a end || ';' || case when turn then coalesce(cb.mirror, b) else b end as labels from t left join c ca on ca.run = t.run and ca.ch = t.a and ca.r = 1 left join c cb on cb.run = t.run and cb.ch = t.b and cb.r = 1""")
def side_regions(spark, d):
    """The scalp list for each nation as a run, with the labels' mean places as channels; odd nations move the right hand."""
    runs = table(spark, d, "nation").select(F.col("n_nationkey").alias("run"), F.when(F.col("n_nationkey") % 2 == 0, "sx").otherwise("dx").alias("side"))
    at = lambda k: F.get("p", F.lit(k))
    places = label_means(spark, d).select(F.col("label").cast("string").alias("ch"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    channels = places.join(runs.select("run")).withColumn("y", F.col("y") + F.col("run") / 1000)
    own = regions.listed(spark, "scalp").withColumn("labels", F.array((F.col("ord") - 1).cast("string"), (F.col("ord") + 1).cast("string")))
    return regions.for_side(own, runs, channels, ["run"]).select("run", "ord", "name", "x", F.array_join("labels", ";").alias("labels"))


#: A vector is the curve of a region in a trial of a synergy, its places are frequencies in Hz; of region 0 it gives the trial's other numbers.
SYN_SQL = """v as (select vec_id // 60 as run, (vec_id // 15) % 4 + 1 as syn, (vec_id // 3) % 5 + 1 as trial, vec_id % 3 as k, ['Mot_LPCG', 'Mot_RPCG', 'SMA'][vec_id % 3 + 1] as roi, embedding::double[] as e from embeddings),
pt as (select run, syn, trial, k, (u - 1)::double as f, least(abs(e[u]) * 2, 1) as c, abs(e[u]) as ic, e[u] * 6 as ph from v, range(1, 65) as r(u)),
ct as (select run, syn, trial, f, avg(c) as c, avg(ic) as ic from pt group by all), mc as (select run, syn, f, avg(c) as c, avg(ic) as ic from ct group by all),
z as (select *, atanh(sqrt(least(greatest(c, 0), 1 - 1e-9))) as z, lead(f) over w as f1, lead(c) over w as c1 from mc window w as (partition by run, syn order by f)),
cm0 as (select run, syn, max(c) filter (f between 1 and 45) as peak_coherence, arg_max(f, c) filter (f between 1 and 45) as peak_hz, avg(c) filter (f between 1 and 45) as mean_1_45_hz, max(c) filter (f between 13 and 30) as beta_peak_coherence, arg_max(f, c) filter (f between 13 and 30) as beta_peak_hz,
avg(c) filter (f between 13 and 30) as beta_mean_13_30_hz, sum((f1 - f) * (c + c1) / 2) filter (f >= 13 and f1 <= 30) as beta_auc_13_30_hz, avg(ic) filter (f between 13 and 30) as im_beta_mean_13_30_hz, max(z) filter (f between 13 and 30) as zcoh_beta_peak, arg_max(f, z) filter (f between 13 and 30) as zcoh_beta_peak_hz, avg(z) filter (f between 13 and 30) as zcoh_beta_mean,
list_sort(list(z) filter (f between 1 and 45)) as zs from z group by run, syn),
cm as (select * exclude (zs), zs[43] + 0.25 * (zs[44] - zs[43]) as zcoh_threshold_95 from cm0),
sf as (select z.run, z.syn, avg((z.z > cm.zcoh_threshold_95)::int) as zcoh_sigfrac_beta from z join cm using (run, syn) where f between 13 and 30 group by all),
st as (select *, lead(c) over w as c1, lead(ph) over w as ph1 from pt where f between 13 and 30 window w as (partition by run, syn, trial, k order by f)),
um as (select run, syn, trial, k, avg(c) as beta, avg(c) filter (f <= 20) as low, avg(c) filter (f >= 20) as high, atan2(avg(sin(ph)), avg(cos(ph))) as angle, sum(sqrt(c * c1) * sin(ph1 - ph)) as psi from st group by all),
un as (select um.*, abs(e[2]) as early, abs(e[3]) as middle, abs(e[4]) as late from um join v using (run, syn, trial, k)),
tm as (select run, syn, trial, avg(beta) as beta, avg(early) as early, avg(middle) as middle, avg(late) as late, avg(psi) as psi, atan2(avg(sin(angle)), avg(cos(angle))) as angle, """ + ", ".join(f"avg({x}) filter (k = {k}) as {x}_{side}" for x in ("beta", "low", "high", "early", "middle", "late") for side, k in (("l", 0), ("r", 1))) + """ from un group by all),
ts as (select run, syn, avg(beta_l) as m1_left_beta_13_30_hz, avg(beta_r) as m1_right_beta_13_30_hz, avg(beta_l - beta_r) as m1_delta_l_minus_r_13_30_hz, avg(early_l - early_r) as m1_delta_l_minus_r_early, avg(middle_l - middle_r) as m1_delta_l_minus_r_middle, avg(late_l - late_r) as m1_delta_l_minus_r_late,
avg(low_l - low_r) as m1_delta_l_minus_r_13_20_hz, avg(high_l - high_r) as m1_delta_l_minus_r_20_30_hz, avg(psi) as psi_beta, avg(early) as beta_early, avg(middle) as beta_middle, avg(late) as beta_late, avg((beta_r - beta_l) / greatest(beta_r + beta_l, 2.220446049250313e-16)) as "lateralization_li_motR_minus_motL",
atan2(avg(sin(angle)), avg(cos(angle))) as phase_beta_mean_rad, case when count(beta) > 1 then stddev_samp(beta) else 0 end as beta_stability_std, case when count(beta) > 1 then stddev_samp(beta) else 0 end / greatest(avg(beta), 2.220446049250313e-16) as beta_stability_cv from tm group by all),
wh as (select run, syn, avg(abs(e[6])) as beta_mean_lagopt_13_30_hz, avg(e[5] * 50) as lag_opt_ms from v where k = 0 group by all),
nu as (select run, syn, s, avg(abs(e[10 + s]) * 2) as b, avg(atanh(sqrt(least(abs(e[30 + s]) * 2, 1 - 1e-9)))) as zz from v, range(1, 21) as r(s) where k = 0 group by all),
ps as (select cm.run, cm.syn, (1 + count(*) filter (b >= beta_mean_13_30_hz)) / (count(b) + 1) as surrogate_p, (1 + count(*) filter (zz >= zcoh_beta_mean)) / (count(zz) + 1) as zcoh_surrogate_p from cm join nu using (run, syn) group by cm.run, cm.syn, beta_mean_13_30_hz, zcoh_beta_mean),
pr as (select *, surrogate_p * count(*) over (partition by run) / count(*) over (partition by run order by surrogate_p) as a, zcoh_surrogate_p * count(*) over (partition by run) / count(*) over (partition by run order by zcoh_surrogate_p) as b from ps),
qs as (select run, syn, surrogate_p, zcoh_surrogate_p, least(1, min(a) over (partition by run order by surrogate_p desc)) as surrogate_q, least(1, min(b) over (partition by run order by zcoh_surrogate_p desc)) as zcoh_surrogate_q from pr),
lv as (select run, 1 - pow(0.05, 1 / (sum(n) - 1)) as c95 from (select distinct run, trial, trial + 3 as n from v) group by run),
t as (select cm.run, cm.syn as synergy, cm.* exclude (run, syn), sf.zcoh_sigfrac_beta, ts.* exclude (run, syn), wh.* exclude (run, syn), qs.* exclude (run, syn), surrogate_q < 0.05 as surrogate_sig, zcoh_surrogate_q < 0.05 as zcoh_surrogate_sig, beta_late - beta_early as beta_delta_late_minus_early, c95
from cm join sf using (run, syn) left join ts using (run, syn) left join wh using (run, syn) left join qs using (run, syn) left join lv using (run))"""

#: What SQL cannot tell of the table of synergies: groups and resampled intervals.
UNTOLD = ("cluster_id", "beta_mean_ci95_low", "beta_mean_ci95_high")
TOLD = [c for c in tables.COLUMNS if c not in UNTOLD]
told = lambda c: f'"{c}"' if c == "synergy" or c.endswith("_sig") else f'round("{c}", 6) + 0.0 as "{c}"'


def synergies_of_vectors(spark, d):
    e = table(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    div = lambda n: F.expr(f"vec_id div {n}")
    roi = F.element_at(F.array(F.lit("Mot_LPCG"), F.lit("Mot_RPCG"), F.lit("SMA")), (F.col("vec_id") % 3 + 1).cast("int"))
    own = e.select(div(60).alias("run"), (div(15) % 4 + 1).alias("syn"), (div(3) % 5 + 1).alias("trial"), roi.alias("roi"), "e")
    c, angle = F.transform("e", lambda x: F.least(F.abs(x) * 2, F.lit(1.0))), F.transform("e", lambda x: x * 6)
    wave = lambda g: F.zip_with(c, angle, lambda a, b: F.sqrt(a) * g(b))
    curves = own.select("run", "syn", "trial", "roi", (F.col("trial") + 3).alias("n_segments"), F.transform("e", lambda x, i: i.cast("double")).alias("f"), c.alias("c"), F.transform("e", F.abs).alias("ic"), angle.alias("angle"), wave(F.cos).alias("re"), wave(F.sin).alias("im"))
    at = lambda k: F.get("e", F.lit(k))
    thirds = own.select("run", "syn", "trial", "roi", F.abs(at(1)).alias("early"), F.abs(at(2)).alias("middle"), F.abs(at(3)).alias("late"))
    whole = own.where("roi = 'Mot_LPCG'").select("run", "syn", "trial", (at(4) * 50).alias("lag_ms"), F.abs(at(5)).alias("lag_beta"), F.transform(F.slice("e", 11, 20), lambda x: F.abs(x) * 2).alias("null"), F.transform(F.slice("e", 31, 20), lambda x: X.fisher_z(F.abs(x) * 2)).alias("null_z"))
    return tables.synergy_table(curves, thirds, whole, ["run", "syn"])


@query("with " + SYN_SQL + " select run, " + ", ".join(told(c) for c in TOLD) + " from t")
def synergy_table(spark, d):
    return rounded(synergies_of_vectors(spark, d).drop(*UNTOLD))


@query("with " + SYN_SQL + " select run, scope, " + ", ".join(told(c) for c in tables.SIDES) + " from (select run, case when grouping(synergy) = 1 then 'all' else printf('syn_%02d', synergy) end as scope, " + ", ".join(f"avg({c}) as {c}" for c in tables.SIDES) + " from t group by grouping sets ((run, synergy), (run)))")
def side_table(spark, d):
    return rounded(tables.side_table(synergies_of_vectors(spark, d), ["run"]))


@query("with " + SYN_SQL + """ select run, count(*) as n_synergies, round(max(c95), 6) as c95, round(avg(beta_mean_13_30_hz), 6) as beta_mean_all, round(avg(beta_auc_13_30_hz), 6) as beta_auc_all, round(avg(zcoh_beta_mean), 6) as zcoh_beta_mean_all, round(avg(zcoh_threshold_95), 6) as zcoh_threshold_beta_all, round(avg(zcoh_sigfrac_beta), 6) as zcoh_sigfrac_beta_all,
round(avg(beta_mean_lagopt_13_30_hz), 6) as beta_mean_lagopt_all, round(avg(lag_opt_ms), 6) + 0.0 as lag_opt_ms_all, round(avg(psi_beta), 6) + 0.0 as psi_beta_all, round(avg(im_beta_mean_13_30_hz), 6) as im_beta_mean_all, round(avg(beta_stability_cv), 6) as beta_stability_cv_all, round(avg(beta_delta_late_minus_early), 6) + 0.0 as gesture_delta_late_minus_early_all,
round(avg("lateralization_li_motR_minus_motL"), 6) + 0.0 as lateralization_li_all, round(avg(m1_left_beta_13_30_hz), 6) as m1_l_beta_all, round(avg(m1_right_beta_13_30_hz), 6) as m1_r_beta_all, round(avg(m1_delta_l_minus_r_13_30_hz), 6) + 0.0 as m1_delta_l_minus_r_all, round(avg(m1_delta_l_minus_r_early), 6) + 0.0 as m1_delta_l_minus_r_early,
round(avg(m1_delta_l_minus_r_middle), 6) + 0.0 as m1_delta_l_minus_r_middle, round(avg(m1_delta_l_minus_r_late), 6) + 0.0 as m1_delta_l_minus_r_late, round(avg(m1_delta_l_minus_r_13_20_hz), 6) + 0.0 as m1_delta_l_minus_r_13_20, round(avg(m1_delta_l_minus_r_20_30_hz), 6) + 0.0 as m1_delta_l_minus_r_20_30,
round(max(beta_peak_coherence), 6) as beta_peak_all, arg_max(beta_peak_hz, beta_peak_coherence) as beta_peak_hz_all, round(max(zcoh_beta_peak), 6) as zcoh_beta_peak_all, arg_max(zcoh_beta_peak_hz, zcoh_beta_peak) as zcoh_beta_peak_hz_all,
round(min(surrogate_p), 6) as surrogate_p_min, round(min(surrogate_q), 6) as surrogate_q_min, count(*) filter (surrogate_sig) as surrogate_sig_count, round(min(zcoh_surrogate_p), 6) as zcoh_surrogate_p_min, round(min(zcoh_surrogate_q), 6) as zcoh_surrogate_q_min, count(*) filter (zcoh_surrogate_sig) as zcoh_surrogate_sig_count from t group by run""")
def synergy_totals(spark, d):
    return rounded(tables.synergy_totals(synergies_of_vectors(spark, d), ["run"]).drop("beta_ci95_low_all", "beta_ci95_high_all"))
