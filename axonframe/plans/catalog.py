"""All queries of the engine by name, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonframe.config import Settings
from axonframe.functions import waveform as wf
from axonframe.functions.ranks import quantiles
from axonframe.operators import cluster as cl
from axonframe.operators import curate as cu
from axonframe.operators import detect as de
from axonframe.operators import moments as mo
from axonframe.operators import neighbours as ne
from axonframe.operators import quality as qu
from axonframe.operators import sort as so
from axonframe.operators import trains as tr
from axonframe.sources import runs
from axonframe.sources import tables as src

DAY = 86_400_000_000
MINUTE = 60_000_000
FS = 20  # samples a second of the stand-in trace
LOW = 5.0  # detection threshold of the stand-in trace

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers the function under its name, with its SQL twin if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, digits: int = 6, **by_name):
    """Doubles rounded, since engines add in different orders: as SQL's round does, the product with a power of ten to the nearest
    whole, and not by decimal digits, where a half may be a half in one way only."""
    kinds = dict(df.dtypes)

    def near(c):
        scale = 10.0 ** by_name.get(c, digits)
        return F.when(F.abs(F.col(c) * scale) < float("inf"), F.round(F.col(c) * scale, 0) / scale).otherwise(F.col(c)).alias(c)

    return df.select(*[near(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


# Tables of the SQL twins.
SPK = "spikes as (select vec_id as spike_id, label as cluster, list_transform(embedding, lambda x: x::double) as w from embeddings)"
PTS = SPK + ", points as (select spike_id, cluster, unnest(w) as v, generate_subscripts(w, 1) - 1 as pos from spikes)"
AE = SPK + ", ae as (select spike_id, cluster, list_min(w) as amplitude, sqrt(list_sum(list_transform(w, lambda x: x * x))) / len(w) as energy from spikes)"
TRC = "trace as (select event_type as channel, row_number() over (partition by event_type order by ts, event_id) - 1 as ix, value as v from events)"
TRN = "train as (select event_id as id, event_type as unit, (user_id % 5)::int as rec, strftime(ts, '%Y-%m-%d') as trial, epoch_us(ts) as us, epoch_us(ts) / 60e6 as t from events)"
REC = "rec as (select r_regionkey as rec, r_regionkey * 5000.0::double + 20000.0 as fs, (r_regionkey * 1000)::bigint as offs from region)"
FEA = "features as (select l_returnflag as cluster, l_quantity as x, l_extendedprice as y, l_discount as z from lineitem)"


def with_shape(spark, sf):
    s = src.spikes(spark, sf)
    return s.withColumn("amplitude", wf.amplitude(F.col("w"))).withColumn("energy", wf.energy(F.col("w")))


# Waveforms ---------------------------------------------------------------------------------------------------------


@query(f"""with {PTS}, lows as (select spike_id, min(pos) as low from points p join (select spike_id as s, min(v) as m from points
group by 1) q on s = spike_id and v = m group by 1),
near as (select spike_id, pos, v, lag(v) over o as b, lead(v) over o as a from points window o as (partition by spike_id order by pos)),
peaks as (select near.spike_id, max(pos) as pk from near join lows on lows.spike_id = near.spike_id where v > b and v > a and pos < low group by 1),
tops as (select p.spike_id, min(pos) as tp from points p join lows on lows.spike_id = p.spike_id join (select p2.spike_id as s, max(v) as m
from points p2 join lows l2 on l2.spike_id = p2.spike_id where pos < low group by 1) q on s = p.spike_id and v = m where pos < low group by 1),
e as (select spike_id, min(v) as amplitude, sqrt(sum(v * v)) / count(*) as energy from points group by 1)
select e.spike_id, round(amplitude, 6) as amplitude, round(energy, 6) as energy, round((lo.v - hi.v) / (low - coalesce(pk, tp)), 6) as slope
from e join lows on lows.spike_id = e.spike_id left join peaks on peaks.spike_id = e.spike_id left join tops on tops.spike_id = e.spike_id
join points lo on lo.spike_id = e.spike_id and lo.pos = low left join points hi on hi.spike_id = e.spike_id and hi.pos = coalesce(pk, tp)""")
def waveform_features(spark, sf):
    s = with_shape(spark, sf)
    return rounded(s.select("spike_id", "amplitude", "energy", wf.slope(F.col("w")).alias("slope")))


@query(f"""with {PTS}, e as (select spike_id as s, sqrt(sum(v * v)) / count(*) as energy from points
group by 1) select spike_id, pos::int as pos, round(v / energy, 6) as v from points join e on s = spike_id""")
def scaled_waveform_samples(spark, sf):
    return rounded(src.spikes(spark, sf).select("spike_id", F.posexplode(wf.scaled(F.col("w"))).alias("pos", "v")))


@query(f"with {PTS} select spike_id, (pos // 10)::int as pos, v from points where pos % 10 = 0")
def downsampled_waveform(spark, sf):
    return src.spikes(spark, sf).select("spike_id", F.posexplode(wf.every(F.col("w"), 10)).alias("pos", "v"))


@query(f"with {PTS} select cluster, min(v) as lo, max(v) as hi from points group by 1")
def waveform_range(spark, sf):
    return qu.waveform_range(src.spikes(spark, sf))


@query(f"with {PTS} select cluster, pos::int as pos, round(avg(v), 6) as mean_v, round(stddev_pop(v), 6) as sd_v, count(*) as n from points group by 1, 2")
def mean_waveform(spark, sf):
    return rounded(qu.mean_waveforms(src.spikes(spark, sf)))


@query(f"""with {PTS} select cluster, (pos // 10)::int as pos, round(avg(v), 6) as mean_v, round(stddev_pop(v), 6) as sd_v, count(*) as n from points
where pos % 10 = 0 group by 1, 2""")
def downsampled_mean_waveform(spark, sf):
    return rounded(qu.mean_waveforms(src.spikes(spark, sf).withColumn("w", wf.every(F.col("w"), 10))))


@query(f"""with {PTS}, grid as (select spike_id, j, j * 0.4::double as x from spikes, (select unnest(range(0, 160)) as j))
select grid.spike_id, j::int as pos, round(a.v + (b.v - a.v) * least(x - a.pos, 1), 6) as v from grid
join points a on a.spike_id = grid.spike_id and a.pos = least(floor(x)::int, 63) join points b on b.spike_id = grid.spike_id
and b.pos = least(floor(x)::int + 1, 63)""")
def resampled_waveform(spark, sf):
    return rounded(src.spikes(spark, sf).select("spike_id", F.posexplode(wf.resampled(F.col("w"), 20.0, 50.0)).alias("pos", "v")))


@query(f"""with recursive {SPK}, levels(spike_id, a, d) as (select spike_id, w, []::double[] from spikes union all
select spike_id, list_transform(range(1, len(a) // 2 + 1), lambda i: (a[2 * i - 1] + a[2 * i]) / sqrt(2)), list_concat(list_transform(range(1,
len(a) // 2 + 1), lambda i: (a[2 * i - 1] - a[2 * i]) / sqrt(2)), d) from levels where len(a) > 1)
select spike_id, (generate_subscripts(c, 1) - 1)::int as k, round(unnest(c), 6) as coef from (select spike_id, list_concat(a, d) as c from levels
where len(a) = 1)""")
def haar_coefficients(spark, sf):
    return rounded(src.spikes(spark, sf).select("spike_id", F.posexplode(wf.haar(F.col("w"))).alias("k", "coef")))


@query(f"""with {PTS}, ends as (select cluster as c, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from points group by 1),
cells as (select cluster, pos::int as pos, least(floor((v - lo) / (hi - lo) * 50), 49)::int as level, count(*) as n from points join ends on c = cluster
where v between lo and hi group by 1, 2, 3)
select cluster, pos, level, n, round(cume_dist() over (partition by cluster order by n), 6) as shade from cells""")
def waveform_density(spark, sf):
    return rounded(qu.waveform_density(src.spikes(spark, sf)))


# Intervals and trains ------------------------------------------------------------------------------------------------


_LINES = f"""{SPK}, v as (select spike_id, cluster, unnest(range(0, (len(w) + 9) // 10)) as i, list_transform(range(0, (len(w) + 9) // 10),
lambda k: w[10 * k + 1]) as p from spikes),
ends as (select cluster as c, quantile_cont(p[i + 1], 0.05) as lo, quantile_cont(p[i + 1], 0.95) as hi from v group by 1),
seg as (select cluster, i, len(p) as m, p[i + 1] as a, p[i + 2] as b, lo, hi from v join ends on c = cluster where i + 1 < len(p)),
inside as (select * from seg where greatest(a, b) >= lo and least(a, b) <= hi),
clipped as (select *, i + case when a < lo then (lo - a) / (b - a) when a > hi then (hi - a) / (b - a) else 0.0::double end as xa,
i + case when b < lo then (lo - a) / (b - a) when b > hi then (hi - a) / (b - a)
else 1.0::double end as xb, least(greatest(a, lo), hi) as ya, least(greatest(b, lo), hi) as yb from inside),
cells as (select cluster, least(floor(xa / (m - 1) * 1600), 1599)::int as x0, least(floor((ya - lo) / (hi - lo) * 1200), 1199)::int as y0,
least(floor(xb / (m - 1) * 1600), 1599)::int as x1, least(floor((yb - lo) / (hi - lo) * 1200), 1199)::int as y1, (i > 0 and a between lo
and hi)::int as goes_on from clipped),
steps as (select *, greatest(abs(x1 - x0), abs(y1 - y0)) as far from cells),
drawn as (select *, unnest(range(goes_on, far + 1)) as k from steps where far > 0 or goes_on = 0),
marks as (select cluster, x0 + (case when far > 0 then floor((2 * k * (x1 - x0) + far) / (2 * far)) else 0 end)::int as x,
y0 + (case when far > 0 then floor((2 * k * (y1 - y0) + far) / (2 * far)) else 0 end)::int as y from drawn),
filled as (select cluster, x, y, count(*) as n from marks group by 1, 2, 3),
shaded as (select *, cume_dist() over (partition by cluster order by n) as shade from filled)"""


@query(f"""with {_LINES} select cluster, x, count(*) as cells, sum(n)::bigint as n, sum(n * y)::bigint as weight, round(sum(shade), 4) as shade from shaded
group by 1, 2""")
def waveform_lines(spark, sf):
    """The density of all clusters' waveforms as lines on a canvas of 1600 by 1200 cells, summed up by column."""
    cells = qu.waveform_lines(src.spikes(spark, sf))
    return rounded(cells.groupBy("cluster", "x").agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("weight"), F.sum("shade").alias("shade")), 4)


@query(f"""with {TRN}, d as (select unit, (us - lag(us) over (partition by unit order by us)) / 60e6 as ms from train)
select unit, count(*) as n, count(ms) as n_isi, count(case when ms < 1 then 1 end) as v1, count(case when ms < 2 then 1 end) as v2,
round(count(case when ms < 1 then 1 end) * 100.0::double / count(*), 6) as v1_pct, round(count(case
when ms < 2 then 1 end) * 100.0::double / count(*), 6) as v2_pct from d group by 1""")
def isi_violations(spark, sf):
    t = tr.intervals(src.train(spark, sf).select("unit", "us"), ["unit"], "us", DAY)
    return rounded(tr.isi_violations(t, ["unit"], F.col("isi") / 60e6))


def _by_recording(spark, sf):
    t = tr.intervals(src.train(spark, sf).select("unit", "rec", "us"), ["unit", "rec"], "us", DAY)
    return t.join(src.recordings(spark, sf), "rec").withColumn("ms", F.col("isi") / F.col("fs") / 1000.0)


@query(f"""with {TRN}, {REC}, d as (select unit, train.rec, (us - lag(us) over (partition by unit, train.rec order by us)) / fs / 1000.0::double as ms
from train join rec on rec.rec = train.rec)
select unit, count(*) as n, count(ms) as n_isi, count(case when ms < 1 then 1 end) as v1, count(case when ms < 2 then 1 end) as v2,
round(count(case when ms < 1 then 1 end) * 100.0::double / count(*), 6) as v1_pct, round(count(case
when ms < 2 then 1 end) * 100.0::double / count(*), 6) as v2_pct from d group by 1""")
def isi_by_recording(spark, sf):
    return rounded(tr.isi_violations(_by_recording(spark, sf), ["unit"], F.col("ms")))


@query(f"""with {TRN}, {REC}, d as (select unit, train.rec, (us - lag(us) over (partition by unit, train.rec order by us)) / fs / 1000.0::double as ms
from train join rec on rec.rec = train.rec)
select rec, count(*) as n, round(avg(ms), 6) as mean_ms, round(median(ms), 6) as median_ms from d group by 1""")
def recording_interval_stats(spark, sf):
    gaps = _by_recording(spark, sf)
    middle = quantiles(gaps, ["rec"], F.col("ms"), {"median_ms": 0.5})
    return rounded(gaps.groupBy("rec").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms")).join(middle, "rec"))


@query(f"""with {TRN}, d as (select unit, (us - lag(us) over (partition by unit order by us)) / 60e6 as ms from train),
c as (select unit, least(floor(ms), 10)::int as bin, count(*) as n from d where ms is not null group by 1, 2)
select u.unit, b.bin::int as bin, coalesce(c.n, 0) as n from (select distinct unit from train) u cross join (select unnest(range(0, 11)) as bin) b
left join c on c.unit = u.unit and c.bin = b.bin""")
def isi_histogram(spark, sf):
    t = tr.intervals(src.train(spark, sf).select("unit", "us"), ["unit"], "us", DAY)
    return tr.isi_histogram(t, ["unit"], F.col("isi") / 60e6)


def _pairs(spark, sf):
    t = src.train(spark, sf).select("id", "unit", "t")
    return t.select(F.col("id").alias("i"), F.col("unit").alias("x"), F.col("t").alias("tx")), t.select(F.col("id").alias("j"), F.col("unit").alias("y"), F.col("t").alias("ty"))


_GRID = "cross join (select unnest(range(0, 40)) as ix) g"
_HIST = "least(floor(d + 20), 39)::int"


@query(f"""with {TRN}, p as (select x.unit as x, y.unit as y, x.t - y.t as d from train x join train y on abs(x.t - y.t) <= 20 where x.unit < y.unit),
c as (select x, y, {_HIST} as ix, count(*) as n from p group by 1, 2, 3), u as (select unit, count(*) as n_x from train group by 1)
select a.unit as x, b.unit as y, (g.ix - 20)::int as bin_start, coalesce(c.n, 0) as n, round(coalesce(c.n, 0) / a.n_x::double, 6) as counts_per_spike_ms
from u a join u b on a.unit < b.unit {_GRID} left join c on c.x = a.unit and c.y = b.unit and c.ix = g.ix""")
def pairwise_correlograms(spark, sf):
    x, _ = _pairs(spark, sf)
    sizes = x.groupBy("x").agg(F.count("*").alias("n_x"))
    grid = sizes.join(F.broadcast(sizes.select(F.col("x").alias("y"))), F.col("x") < F.col("y"))
    return rounded(tr.on_grid(tr.pair_lags(x, "x", "tx", 20), ["x", "y"], grid, 20))


@query(f"""with {TRN}, p as (select x.t - y.t as d from train x join train y on abs(x.t - y.t) <= 20 where x.unit = 'click' and y.unit = 'view'),
c as (select {_HIST} as ix, count(*) as n from p group by 1),
u as (select unit as x, count(*) as n_x from train where unit = 'click' group by 1)
select x, (g.ix - 20)::int as bin_start, coalesce(c.n, 0) as n, round(coalesce(c.n, 0) / n_x::double, 6) as counts_per_spike_ms from u {_GRID}
left join c on c.ix = g.ix""")
def cross_correlogram(spark, sf):
    x, y = _pairs(spark, sf)
    x, y = x.where("x = 'click'"), y.where("y = 'view'")
    return rounded(tr.correlogram(tr.band_join(x, y, [], "tx", "ty", 20.0), ["x"], F.col("tx") - F.col("ty"), x.groupBy("x").agg(F.count("*").alias("n_x")), 20))


@query(f"""with {TRN}, p as (select x.unit as x, x.t - y.t as d from train x join train y on x.unit = y.unit and x.id <> y.id and abs(x.t - y.t) <= 20),
c as (select x, {_HIST} as ix, count(*) as n from p group by 1, 2),
u as (select unit as x, count(*) as n_x from train group by 1)
select u.x, (g.ix - 20)::int as bin_start, coalesce(c.n, 0) as n, round(coalesce(c.n, 0) / n_x::double, 6) as counts_per_spike_ms from u {_GRID}
left join c on c.ix = g.ix and c.x = u.x""")
def auto_correlogram(spark, sf):
    x, y = _pairs(spark, sf)
    pairs = tr.band_join(x, y.withColumnRenamed("y", "x"), ["x"], "tx", "ty", 20.0).where("i <> j")
    return rounded(tr.correlogram(pairs, ["x"], F.col("tx") - F.col("ty"), x.groupBy("x").agg(F.count("*").alias("n_x")), 20))


def _in_day(spark, sf):
    return src.train(spark, sf).select("unit", "trial", (F.col("us") % DAY).alias("at"))


def _rates(spark, sf):
    return tr.psth(_in_day(spark, sf), ["unit", "trial"], "at", 0, DAY, 240 * MINUTE, 60 * MINUTE, MINUTE)


def _centred(spark, sf):
    return _rates(spark, sf).withColumn("center", F.col("center") - DAY // 2)


_RATES = f"""{TRN}, inday as (select unit, trial, us % {DAY} as tod from train), starts as (select unnest(range(0, 20)) * {60 * MINUTE} as start),
hits as (select unit, trial, start, count(*) as n from inday join starts on tod >= start and tod <= start + {240 * MINUTE} group by 1, 2, 3),
rates as (select k.unit, k.trial, (s.start + {120 * MINUTE})::bigint as center, coalesce(n, 0) * 1000.0::double / 240 as rate
from (select distinct unit, trial from inday) k cross join starts s
left join hits on hits.unit = k.unit and hits.trial = k.trial and hits.start = s.start),
centred as (select unit, trial, center - {DAY // 2} as center, rate from rates)"""


@query(f"with {_RATES} select unit, trial, center, round(rate, 6) as rate from rates")
def psth(spark, sf):
    return rounded(_rates(spark, sf))


@query(f"with {_RATES} select unit, center, round(sum(rate) / (select count(distinct trial) from rates), 6) as rate from rates group by 1, 2")
def mean_psth(spark, sf):
    return rounded(tr.mean_psth(_rates(spark, sf)))


_W = tr.gaussian_weights(3.0)
_MIRROR = "case when ((ix + k) % 40 + 40) % 40 < 20 then ((ix + k) % 40 + 40) % 40 else 39 - ((ix + k) % 40 + 40) % 40 end"


@query(f"""with {_RATES}, w as (select unnest({[k - len(_W) // 2 for k in range(len(_W))]}) as k, unnest({[float(x) for x in _W]}) as weight),
r as (select unit, trial, center, rate, row_number() over (partition by unit, trial order by center) - 1 as ix from rates)
select r.unit, r.trial, r.center, round(sum(weight * o.rate), 4) as rate
from r cross join w join r o on o.unit = r.unit and o.trial = r.trial and o.ix = {_MIRROR.replace('ix', 'r.ix')} group by 1, 2, 3""")
def smoothed_psth(spark, sf):
    return rounded(tr.smoothed(_rates(spark, sf), ["unit", "trial"]), 4)


@query(f"""with {TRN}, inday as (select unit, trial, us % {DAY} as tod from train), starts as (select unnest(range(0, 45)) * {30 * MINUTE} as start),
hits as (select unit, trial, start, count(*) as n from inday join starts on tod >= start and tod <= start + {120 * MINUTE} group by 1, 2, 3)
select k.unit, k.trial, (s.start + {60 * MINUTE})::bigint as center, round(coalesce(n, 0) * 1000.0::double / 120, 6) as rate from (select distinct unit, trial
from inday) k cross join starts s
left join hits on hits.unit = k.unit and hits.trial = k.trial and hits.start = s.start""")
def binned_rate(spark, sf):
    return rounded(tr.binned_rate(_in_day(spark, sf), ["unit", "trial"], "at", 0, DAY, 120 * MINUTE, 30 * MINUTE, MINUTE))


@query(f"""with {_RATES}, b as (select unit, trial, avg(rate) as m from centred where center < 0 group by 1, 2),
s as (select unit, avg(m) as mean, stddev_pop(m) as sd from b group by 1)
select c.unit, trial, center, round((rate - mean) / nullif(sd, 0), 4) as z from centred c join s on s.unit = c.unit""")
def zscore_baseline(spark, sf):
    return rounded(tr.zscored(_centred(spark, sf)), 4)


@query(f"""with {_RATES}, b as (select unit, avg(rate) as base from centred where center < 0
group by 1) select c.unit, trial, center, round(rate - base, 4) as rate from centred c join b on b.unit = c.unit""")
def remove_baseline(spark, sf):
    return rounded(tr.without_baseline(_centred(spark, sf)), 4)


@query(f"""with {_RATES}, s as (select unit, avg(case when center < 0 then rate end) as ma, avg(case when center >= 0 then rate end) as mb, var_pop(case
when center < 0 then rate end) as va, var_pop(case when center >= 0 then rate end) as vb,
count(case when center < 0 then 1 end) as na, count(case when center >= 0 then 1 end) as nb from centred
group by 1) select unit, round(mb - ma, 4) as difference, round(sqrt(va / na + vb / nb) / sqrt(na + nb), 4) as sem from s""")
def mean_difference(spark, sf):
    return rounded(tr.mean_difference(_centred(spark, sf), ["unit"], "rate", F.col("center") >= 0), 4)


@query(f"""with {_RATES}, r as (select unit, center >= 0 as b, rate, rank() over (partition by unit
order by rate) + (count(*) over (partition by unit, rate) - 1) / 2.0 as rk from centred),
s as (select unit, count(case when not b then 1 end) as n_a, count(case when b then 1 end) as n_b, sum(case when b then rk end) as rb from r group by 1),
t as (select unit, sum(c * c * c - c)::double as ties from (select unit, rate, count(*) as c from centred group by 1, 2) group by 1),
u as (select s.unit, n_a, n_b, (rb - n_b * (n_b + 1) / 2.0)::double as ub, ties from s join t on t.unit = s.unit)
select unit, n_a::bigint as n_a, n_b::bigint as n_b, round(n_a::double * n_b - (n_a::double * n_b - ub), 4) as u,
round(sign(ub - n_a * n_b / 2.0) * greatest(abs(ub - n_a * n_b / 2.0) - 0.5,
0) / sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1)))), 4) as z from u""")
def mann_whitney_u(spark, sf):
    return rounded(tr.mann_whitney(_centred(spark, sf), ["unit"], "rate", F.col("center") < 0).select("unit", F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"), "u", "z"), 4)


_SIDE = "case when center {} 0 then rate end"
_TEST = SQL["mann_whitney_u"].rpartition("select unit, n_a::bigint")[0]


@query(f"""{_TEST.rstrip()}, s2 as (select unit, count({_SIDE.format('<')}) as n_before, count({_SIDE.format('>=')}) as n_after,
avg({_SIDE.format('<')}) as mean_before, avg({_SIDE.format('>=')}) as mean_after,
stddev_pop({_SIDE.format('<')}) as sb, stddev_pop({_SIDE.format('>=')}) as sa from centred group by 1),
z as (select unit, n_a::double * n_b - ub as u0, ub, -sign(n_a::double * n_b - ub - n_a * n_b / 2.0) * greatest(abs(n_a::double * n_b - ub - n_a * n_b / 2.0) - 0.5, 0) / sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1)))) as z from u),
e as (select unit, ub, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) as t from z)
select s2.unit, n_before, n_after, round(mean_before, 4) as mean_before, round(sb / sqrt(n_before), 4) as sem_before, round(mean_after, 4) as mean_after,
round(sa / sqrt(n_after), 4) as sem_after,
round(mean_after - mean_before, 4) as delta, round(sqrt(sb * sb / n_before + sa * sa / n_after) / sqrt(n_before + n_after), 4) as delta_sem, round(ub,
4) as u, round(z, 4) as z,
round(least(1.0, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2)), 4) as p
from s2 join e on e.unit = s2.unit""")
def response_test(spark, sf):
    """Rates before and after, their difference, and the Mann-Whitney test with its two-sided p."""
    return rounded(tr.response_test(_centred(spark, sf), ["unit"], "rate", F.col("center") >= 0), 4)


@query(f"""with {TRN}, {REC} select id, unit, (us % {DAY} + offs) / (fs / 1000.0::double) as time_ms, (us % {DAY} + offs) / fs as time_s
from train join rec on rec.rec = train.rec""")
def unit_time_vector(spark, sf):
    s = src.train(spark, sf).select("id", "unit", "rec", (F.col("us") % DAY).alias("sample"))
    ms = tr.unit_times(s, src.recordings(spark, sf), "ms").withColumnRenamed("time", "time_ms")
    return tr.unit_times(ms, src.recordings(spark, sf), "s").select("id", "unit", "time_ms", F.col("time").alias("time_s"))


@query(f"""with {TRN}, {REC}, m as (select rec.rec, fs, max(us % 1000000) as last from rec left join train on train.rec = rec.rec group by 1, 2)
select rec, floor(coalesce(sum(coalesce(last, 0) + 3 * fs) over (order by rec rows between unbounded preceding and 1 preceding), 0))::bigint as "offset"
from m""")
def recording_offsets(spark, sf):
    s = src.train(spark, sf).select("rec", (F.col("us") % 1_000_000).alias("sample"))
    return tr.recording_offsets(s, src.recordings(spark, sf))


@query(f"""with {TRN}, f as (select unit as u, min(us) as t0, max(us) as t1 from train
group by 1) select unit, ((us - t0) // {5 * DAY})::int as "window", count(*) as n, min(us) as first_t, max(us) as last_t
from train join f on u = unit where (t1 - t0) / {5 * DAY} < 10 group by 1, 2""")
def windows_over_time(spark, sf):
    return tr.windows_over_time(src.train(spark, sf).select("unit", "us"), ["unit"], "us", 5 * DAY)


# Detection -----------------------------------------------------------------------------------------------------------


@query(f"with {TRC} select channel, round(avg(v) - 5 * median(abs(v) / 0.6745), 6) as threshold from trace group by 1")
def detection_threshold(spark, sf):
    return rounded(de.detection_threshold(src.trace(spark, sf)))


_RUNS = f"""{TRC}, low as (select channel, ix, v, ix - row_number() over (partition by channel order by ix) as grp from trace where v <= {LOW}),
runs as (select channel, ix, v, dense_rank() over (partition by channel order by grp)::bigint as run from low)"""


@query(f"with {_RUNS} select channel, run, min(ix) as first_ix, max(ix) as last_ix, count(*) as n from runs group by 1, 2")
def threshold_runs(spark, sf):
    return de.threshold_runs(src.trace(spark, sf), LOW)


_FOUND = f"""{_RUNS}, found as (select channel, run, ix, v from (select *, row_number() over (partition by channel, run order by v, ix) as k from runs)
where k = 1)"""


@query(f"with {_FOUND} select channel, run, ix, v from found")
def detected_spikes(spark, sf):
    return de.detected_spikes(src.trace(spark, sf), LOW)


_PLACES = de.snapshot_places(10_000.0, 0.5, 1.0)


@query(f"""with {_FOUND}, places as (select unnest({_PLACES}) as at, unnest(range(0, {len(_PLACES)})) as pos),
s as (select found.channel, found.ix, pos, t.v, count(*) over (partition by found.channel, found.ix) as n
from found cross join places join trace t on t.channel = found.channel and t.ix = found.ix + places.at)
select channel, ix, pos::int as pos, v from s where n = {len(_PLACES)}""")
def spike_snapshots(spark, sf):
    s = de.spike_snapshots(src.trace(spark, sf), LOW, 10_000.0)
    return s.withColumn("pos", F.col("pos").cast("int"))


_CUT = f"""{TRC}, sizes as (select channel, max(ix) + 1 as n, (max(ix) + 1) // {FS} as seconds, count(case when v > 120 then 1 end) as breaches from trace
group by 1),
secs as (select trace.channel, ix // {FS} as sec, count(case when v > 120 then 1 end) as b from trace join sizes on sizes.channel = trace.channel
where ix // {FS} < seconds group by 1, 2),
st as (select channel, count(case when b > 0 then 1 end) as secs_above, coalesce(avg(case when b > 0 then b end), 0) as mean_breaches, min(case
when b > 2.0 then sec end) as early from secs group by 1),
cuts as (select sizes.channel, seconds, breaches * {FS}::double / n as breach_rate, secs_above, mean_breaches,
case when breaches * {FS}::double / n >= 1.0 and secs_above >= 2 and mean_breaches >= 2.0 then coalesce(early, seconds) else seconds end as cutoff
from sizes join st on st.channel = sizes.channel)"""


def _cutoffs(spark, sf):
    return de.recording_cutoff(src.trace(spark, sf), FS, 120.0, 1.0, 2, 2.0)


@query(f"with {_CUT} select channel, seconds, round(breach_rate, 6) as breach_rate, secs_above, round(mean_breaches, 6) as mean_breaches, cutoff from cuts")
def recording_cutoff(spark, sf):
    return rounded(_cutoffs(spark, sf))


@query(f"with {_CUT} select trace.channel, ix, v from trace join cuts on cuts.channel = trace.channel where cutoff >= 1 and ix < cutoff * {FS}")
def trace_truncated(spark, sf):
    return de.truncated(src.trace(spark, sf), _cutoffs(spark, sf), FS, 1)


@query(f"with {TRC} select channel, ix // {FS} as sec, round(avg(v), 6) as mean_v from trace group by 1, 2")
def voltage_per_second(spark, sf):
    return rounded(de.voltage_per_second(src.trace(spark, sf), FS))


@query(f"""with {TRC}, s as (select channel as c, stddev_pop(v) as sd from trace group by 1) select channel, ix, v from trace join s on c = channel
where abs(v) < 3 * sd""")
def artifacts_removed(spark, sf):
    return de.without_artifacts(src.trace(spark, sf), 3.0)


@query(f"""with {TRC}, m as (select channel, max(abs(v)) * stddev_samp(v) as m from trace
group by 1) select channel, round(m, 4) as measure, m > (select median(m) + 1.5 * stddev_samp(m) from m) as outlier from m""")
def outlier_channels(spark, sf):
    m = src.trace(spark, sf).groupBy("channel").agg((F.max(F.abs("v")) * F.stddev_samp("v")).alias("measure"))
    limit = m.agg((F.median("measure") + 1.5 * F.stddev_samp("measure")).alias("limit"))
    return rounded(m.crossJoin(limit).select("channel", "measure", (F.col("measure") > F.col("limit")).alias("outlier")), 4)


@query()
def bandpassed_trace(spark, sf):
    return rounded(de.bandpass(src.trace(spark, sf), 20_000.0, 300.0, 3000.0))


@query()
def dejittered_waveforms(spark, sf):
    s = src.spikes(spark, sf).select("spike_id", wf.dejittered(F.col("w"), 8, 16).alias("w")).where("w is not null")
    return rounded(s.select("spike_id", F.posexplode("w").alias("pos", "v")))


# Unit quality --------------------------------------------------------------------------------------------------------


_COV2 = """m as (select cluster as c, count(*) as n, avg(amplitude) as ma, avg(energy) as me, var_samp(amplitude) as saa, var_samp(energy) as see,
covar_samp(amplitude, energy) as sae from ae where cluster >= 0 group by 1),
out as (select c, n, ((amplitude - ma) * (amplitude - ma) * see - 2 * (amplitude - ma) * (energy - me) * sae + (energy - me) * (energy - me) * saa) / (saa * see - sae * sae) as d2 from ae join m on cluster <> c),
l as (select c, n, sum(exp(-d2 / 2)) / n as l_ratio from out group by 1, 2)"""


@query(f"with {AE}, {_COV2} select c as cluster, n, round(l_ratio, 6) as l_ratio from l")
def l_ratio(spark, sf):
    return rounded(qu.l_ratios(with_shape(spark, sf), ["amplitude", "energy"]))


_LI3 = """features as (select l_linenumber as cluster, l_quantity as x, l_extendedprice as y, l_discount as z from lineitem),
m as (select cluster as component, count(*) as n, avg(x) mx, avg(y) my, avg(z) mz,
covar_samp(x, x) xx, covar_samp(y, y) yy, covar_samp(z, z) zz, covar_samp(x, y) xy, covar_samp(x, z) xz, covar_samp(y, z) yz from features group by 1),
inv as (select *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) as det from m),
d as (select component, n, ((x - mx) * (x - mx) * (yy * zz - yz * yz) + (y - my) * (y - my) * (xx * zz - xz * xz) + (z - mz) * (z - mz) * (xx * yy - xy * xy)
+ 2 * (x - mx) * (y - my) * (xz * yz - xy * zz) + 2 * (x - mx) * (z - mz) * (xy * yz - xz * yy) + 2 * (y - my) * (z - mz) * (xy * xz - xx * yz)) / det as d2
from features join inv on cluster <> component),
e as (select component, n, d2, sqrt(d2 / 2) as q, 1 / (1 + 0.5 * sqrt(d2 / 2)) as t from d)"""


@query(f"""with {_LI3} select component as cluster, n, round(sum(t * exp(-q * q - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))
+ exp(-d2 / 2) * sqrt(d2 / 2) * 2 / sqrt(pi())) / n, 4) as l_ratio from e group by 1, 2""")
def l_ratio_three(spark, sf):
    """L-ratios by three columns, an odd number of degrees of freedom."""
    f = src.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("cluster"), *[F.col(c).alias(n) for c, n in (("l_quantity", "x"), ("l_extendedprice", "y"), ("l_discount", "z"))])
    return rounded(qu.l_ratios(f, ["x", "y", "z"]), 4)


_SOLVED = "lab as (select s.solution::int as solution, l_returnflag as channel, (l_partkey % s.solution)::int as cluster, l_quantity as x, l_extendedprice as y from lineitem cross join (select unnest(range(3, 6)) as solution) s)"


@query(f"""with {_SOLVED}, m as (select channel as mc, solution as ms, cluster as c, count(*) as n, avg(x) mx, avg(y) my, var_samp(x) xx, var_samp(y) yy,
covar_samp(x, y) xy from lab group by 1, 2, 3)
select mc as channel, ms as solution, c as cluster, n, round(sum(exp(-((x - mx) * (x - mx) * yy - 2 * (x - mx) * (y - my) * xy + (y - my) * (y - my) * xx) / (xx * yy - xy * xy) / 2)) / n, 3) as l_ratio
from lab join m on mc = channel and ms = solution and c <> cluster group by 1, 2, 3, 4""")
def l_ratio_by_solution(spark, sf):
    """L-ratios within each solution of each channel."""
    f = src.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("channel"), "l_partkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    f = f.withColumn("solution", F.explode(F.sequence(F.lit(3), F.lit(5)))).withColumn("cluster", (F.col("l_partkey") % F.col("solution")).cast("int"))
    return rounded(qu.l_ratios(f, ["x", "y"], "cluster", ["channel", "solution"]), 3)


_COMPILED = """q as (select l_returnflag as channel, l_linenumber as solution, (l_suppkey % 3)::int as cluster, count(*) as n, avg(l_discount) * 10 as v1_pct,
avg(l_tax) * 20 as v2_pct, avg(l_tax) * 2.5 as l_ratio from lineitem where l_linenumber > 1 group by 1, 2, 3),
grid as (select channel, solution::int as solution from (select distinct l_returnflag as channel
from lineitem) cross join (select unnest(range(1, 9)) as solution))"""


def _compiled(spark, sf):
    li = src.table(spark, sf, "lineitem").withColumnsRenamed({"l_returnflag": "channel", "l_linenumber": "solution"})
    q = li.where("solution > 1").groupBy("channel", "solution", (F.col("l_suppkey") % 3).cast("int").alias("cluster")).agg(F.count("*").alias("n"), (F.avg("l_discount") * 10).alias("v1_pct"), (F.avg("l_tax") * 20).alias("v2_pct"), (F.avg("l_tax") * 2.5).alias("l_ratio"))
    grid = li.select("channel").distinct().withColumn("solution", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return qu.compiled_report(q, grid, ["channel", "solution"])


@query(f"""with {_COMPILED} select channel, solution, cluster, n, round(v1_pct, 4) as v1_pct, round(v2_pct, 4) as v2_pct, round(l_ratio, 4) as l_ratio,
v1_pct <= 0.5 and l_ratio <= 0.1 as isolated,
case when v1_pct > 1 and l_ratio > 0.1 then 'red' when (v1_pct > 0.5 and l_ratio > 0.1) or v1_pct > 1 then 'orange'
when v1_pct > 0.5 or l_ratio > 0.1 then 'yellow' end as severity from q""")
def compiled_report(spark, sf):
    """Quality of all solutions of all channels in one table."""
    return rounded(_compiled(spark, sf)[0], 4)


@query(f"with {_COMPILED} select channel, solution from grid where not exists (select 1 from q where q.channel = grid.channel and q.solution = grid.solution)")
def missing_solutions(spark, sf):
    return _compiled(spark, sf)[1]


_ISO = f"""{AE}, {_COV2}, timed as (select cluster, epoch_us(ts) as t from spikes join events on event_id = spike_id),
d as (select cluster, (t - lag(t) over (partition by cluster order by t)) / 3600e6 as ms from timed),
v as (select cluster, count(*) as n_timed, count(case when ms < 1 then 1 end) as v1, count(case when ms < 2 then 1 end) as v2, count(case
when ms < 1 then 1 end) * 100.0::double / count(*) as v1_pct, count(case when ms < 2 then 1 end) * 100.0::double / count(*) as v2_pct from d group by 1)"""


@query(f"""with {_ISO} select cluster, n, v1, v2, round(v1_pct, 6) as v1_pct, round(v2_pct, 6) as v2_pct, round(l_ratio, 6) as l_ratio, v1_pct <= 0.5
and l_ratio <= 0.1 as isolated,
case when v1_pct > 1 and l_ratio > 0.1 then 'red' when (v1_pct > 0.5 and l_ratio > 0.1) or v1_pct > 1 then 'orange'
when v1_pct > 0.5 or l_ratio > 0.1 then 'yellow' end as severity
from l join v on cluster = c""")
def isolation_report(spark, sf):
    ratios = qu.l_ratios(with_shape(spark, sf), ["amplitude", "energy"])
    t = tr.intervals(src.timed_spikes(spark, sf).select("cluster", "t"), ["cluster"], "t", DAY)
    v = tr.isi_violations(t, ["cluster"], F.col("isi") / 3600e6).drop("n", "n_isi")
    r = ratios.join(v, "cluster").withColumn("isolated", qu.isolated(F.col("v1_pct"), F.col("l_ratio"))).withColumn("severity", qu.severity(F.col("v1_pct"), F.col("l_ratio")))
    return rounded(r.select("cluster", "n", "v1", "v2", "v1_pct", "v2_pct", "l_ratio", "isolated", "severity"))


_MAH = f"""{FEA}, m as (select cluster as component, avg(x) mx, avg(y) my, avg(z) mz, var_samp(x) xx, var_samp(y) yy, var_samp(z) zz, covar_samp(x, y) xy,
covar_samp(x, z) xz, covar_samp(y, z) yz from features group by 1),
inv as (select *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) as det from m),
dist as (select cluster, component, sqrt(((x - mx) * (x - mx) * (yy * zz - yz * yz) + (y - my) * (y - my) * (xx * zz - xz * xz) + (z - mz) * (z - mz) * (xx * yy - xy * xy)
+ 2 * (x - mx) * (y - my) * (xz * yz - xy * zz) + 2 * (x - mx) * (z - mz) * (xy * yz - xz * yy) + 2 * (y - my) * (z - mz) * (xy * xz - xx * yz)) / det) as distance from features cross join inv)"""


@query(f"""with {_MAH} select cluster, component, count(*) as n, round(avg(distance), 4) as mean_d, round(min(distance), 4) as min_d, round(max(distance),
4) as max_d from dist group by 1, 2""")
def mahalanobis_to_clusters(spark, sf):
    d = qu.mahalanobis(src.features(spark, sf), ["x", "y", "z"])
    return rounded(d.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.avg("distance").alias("mean_d"), F.min("distance").alias("min_d"), F.max("distance").alias("max_d")), 4)


@query(f"""with {_MAH}, e as (select cluster as c, component as k, min(distance) as lo, max(distance) as hi from dist group by 1, 2)
select cluster, component, least(floor((distance - lo) / ((hi - lo) / 10)), 9)::int as bin, count(*) as n from dist join e on c = cluster and k = component
group by 1, 2, 3""")
def mahalanobis_histogram(spark, sf):
    return qu.equal_bins(qu.mahalanobis(src.features(spark, sf), ["x", "y", "z"]), ["cluster", "component"], "distance")


@query(f"""with {AE}, s as (select cluster as c, avg(amplitude) as m, stddev_pop(amplitude) as sd from ae
group by 1) select cluster, count(*) as n, count(case when amplitude <= m - 1.5 * sd then 1 end) as rejected, count(case
when not amplitude <= m - 1.5 * sd then 1 end) as kept
from ae join s on c = cluster group by 1""")
def amplitude_outliers(spark, sf):
    r = qu.without_outliers(with_shape(spark, sf).select("cluster", "amplitude"), "amplitude", 1.5)
    return r.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("kept_cluster") == -1).alias("rejected"), F.count_if(F.col("kept_cluster") != -1).alias("kept"))


@query(f"""with {FEA}, g as (select s.solution, c.component from (select unnest(range(2, 8)) as solution) s join (select unnest(range(0, 7)) as component) c
on component < solution),
lab as (select s.solution, (l_partkey % s.solution)::bigint as component from lineitem cross join (select unnest(range(2, 8)) as solution) s),
n as (select solution, component, count(*) as n from lab group by 1, 2)
select g.solution::int as solution, not bool_or(coalesce(n, 0) <= 5) as valid from g left join n on n.solution = g.solution and n.component = g.component
group by 1""")
def cluster_sizes_valid(spark, sf):
    solutions = spark.range(2, 8).select(F.col("id").cast("int").alias("solution"))
    grid = solutions.withColumn("component", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("solution") - 1).cast("long"))))
    rows = src.table(spark, sf, "lineitem").select("l_partkey").withColumn("solution", F.explode(F.sequence(F.lit(2), F.lit(7))))
    sizes = rows.groupBy("solution", (F.col("l_partkey") % F.col("solution")).alias("component")).agg(F.count("*").alias("n"))
    return cl.valid_solutions(grid.join(sizes, ["solution", "component"], "left"), 3)


@query(f"""with {FEA} select 'x' as a, 'y' as b, round(corr(x, y), 6) as r from features union all select 'x', 'z', round(corr(x, z), 6) from features
union all select 'y', 'z', round(corr(y, z), 6) from features""")
def feature_pairs(spark, sf):
    names = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "pos int, name string")
    wide = src.features(spark, sf).agg(F.corr("x", "y").alias("xy"), F.corr("x", "z").alias("xz"), F.corr("y", "z").alias("yz"))
    long = wide.unpivot([], ["xy", "xz", "yz"], "pair", "r")
    return rounded(cl.feature_pairs(names).withColumn("pair", F.concat("a", "b")).join(long, "pair").select("a", "b", "r"))


_FITS = "fits as (select l_returnflag as channel, l_linenumber as k, (l_suppkey % 10)::bigint as seed, avg(l_extendedprice) as bic, max(l_discount) > 0.05 as converged from lineitem group by 1, 2, 3)"


@query(f"""with {_FITS} select channel, k, seed, round(bic, 4) as bic from (select *, row_number() over (partition by channel, k order by bic, seed) as rk
from fits where converged) where rk = 1""")
def best_restart_by_bic(spark, sf):
    rows = src.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_linenumber").alias("k"), (F.col("l_suppkey") % 10).alias("seed"), "l_extendedprice", "l_discount")
    fits = rows.groupBy("channel", "k", "seed").agg(F.avg("l_extendedprice").alias("bic"), (F.max("l_discount") > 0.05).alias("converged"))
    return rounded(cl.best_fits(fits, ["channel", "k"]), 4)


@query("select channel, k::int as k, seed::int as seed from (select distinct event_type as channel from events) cross join (select unnest(range(2, 8)) as k) cross join (select unnest(range(0, 10)) as seed)")
def cluster_grid(spark, sf):
    return cl.cluster_grid(src.table(spark, sf, "events").select(F.col("event_type").alias("channel")).distinct())


@query()
def gmm_best(spark, sf):
    """The best mixture of each recording's spikes by BIC, over cluster counts and seeds, in grouped NumPy fits."""
    rows = with_shape(spark, sf).withColumn("slope", F.coalesce(wf.slope(F.col("w")), F.lit(0.0))).withColumn("channel", F.col("cluster") % 2)
    return rounded(cl.chosen_models(cl.mixtures(rows, "channel", ["amplitude", "energy", "slope"])).select("channel", "seed", "bic"), 3)


@query()
def gmm_labels(spark, sf):
    """Spikes by component of a mixture of three, one of each recording: labels by posterior and the rows of each."""
    rows = with_shape(spark, sf).withColumn("channel", F.col("cluster") % 2)
    models = cl.chosen_models(cl.mixtures(rows, "channel", ["amplitude", "energy"], 3, 3, 2))
    return rounded(cl.labelled(rows.drop("cluster"), models, ["amplitude", "energy"]).select("channel", "spike_id", "cluster", "log_density"), 3)


@query()
def metric_table(spark, sf):
    """The six columns that spikes are clustered by; components without sign."""
    m = cl.metric_table(src.spikes(spark, sf))
    return rounded(m.select("spike_id", "amplitude", "energy", "slope", *[F.abs(f"pc{i}").alias(f"pc{i}") for i in range(3)]), 4)


@query(f"""with {AE}, t as (select event_id, epoch_us(ts) as t, value as v
from events) select spike_id, round(amplitude, 6) as amplitude, round(energy, 6) as energy, t, v from ae join t on event_id = spike_id""")
def feature_assembly(spark, sf):
    shape = with_shape(spark, sf)
    times = src.table(spark, sf, "events").select(F.col("event_id").alias("spike_id"), F.expr(src.MICROS).alias("t"), F.col("value").alias("v"))
    return rounded(cl.assembled([shape.select("spike_id", "amplitude"), shape.select("spike_id", "energy"), times]))


@query()
def pooled_pca(spark, sf):
    s = cl.pooled_components(src.spikes(spark, sf), [0, 1, 2], 2)
    return rounded(s.select("cluster", "spike_id", *[F.abs(F.get("pcs", F.lit(i))).alias(f"pc{i}") for i in range(2)]), 4)


@query(f"with {AE} select spike_id, cluster, round(amplitude, 6) as x, round(energy, 6) as y from ae where cluster >= 0")
def feature_scatter(spark, sf):
    return rounded(with_shape(spark, sf).where("cluster >= 0").select("spike_id", "cluster", F.col("amplitude").alias("x"), F.col("energy").alias("y")))


SORT_FS = 2.0  # samples a second of the stand-in trace in the sorting job, so that the shortest lasts for more than 60 s
SORT_TIMES = 0.5
SORT_SETTINGS = Settings(breach_voltage_cutoff=120.0, breach_max_breach_rate=0.5, breach_max_breach_count=2, breach_max_breach_avg=1.5, filter_low_cutoff=0.02, filter_high_cutoff=0.9, spike_pre_time=1000.0, spike_post_time=2000.0, cluster_max_clusters=3, cluster_random_restarts=2)
_KERNEL = [float(x) for x in de.bandpass_kernel(SORT_FS, SORT_SETTINGS.filter_low_cutoff, SORT_SETTINGS.filter_high_cutoff)]
_SNAP = de.snapshot_places(SORT_FS, SORT_SETTINGS.spike_pre_time, SORT_SETTINGS.spike_post_time)
_PRE, _POST = (int(ms * SORT_FS / 1000) for ms in (SORT_SETTINGS.spike_pre_time, SORT_SETTINGS.spike_post_time))
_SORT = f"""{TRC}, taps as (select unnest({_KERNEL}) as c, unnest(range(0, {len(_KERNEL)})) - {len(_KERNEL) // 2} as k),
line as (select a.channel, a.ix, sum(b.v * c) as v from trace a join taps on true join trace b on b.channel = a.channel and b.ix = a.ix - k group by 1, 2),
sizes as (select channel, count(*) as n, count(*) // {int(SORT_FS)} as seconds, count(case when v > 120 then 1 end) as breaches from line group by 1),
secs as (select line.channel, ix // {int(SORT_FS)} as sec, count(case when v > 120 then 1 end) as b
from line join sizes on sizes.channel = line.channel where ix // {int(SORT_FS)} < seconds group by 1, 2),
st as (select channel, count(case when b > 0 then 1 end) as above, coalesce(avg(case when b > 0 then b end), 0) as mean_b, min(case
when b > 1.5 then sec end) as early from secs group by 1),
cuts as (select sizes.channel, seconds, case when breaches * {SORT_FS}::double / n >= 0.5 and above >= 2 and mean_b >= 1.5 then coalesce(early, seconds)
else seconds end as cutoff
from sizes join st on st.channel = sizes.channel),
kept as (select line.* from line join cuts on cuts.channel = line.channel where cutoff >= 60 and ix < cutoff * {int(SORT_FS)}),
limits as (select channel, avg(v) - {SORT_TIMES} * median(abs(v) / 0.6745) as threshold from kept group by 1),
low as (select kept.channel, ix, v, ix - row_number() over (partition by kept.channel order by ix) as grp
from kept join limits on limits.channel = kept.channel where v <= threshold),
found as (select channel, ix from (select *, row_number() over (partition by channel, grp order by v, ix) as k from low) where k = 1),
snap as (select unnest({_SNAP}) as at, unnest(range(0, {len(_SNAP)})) as pos),
whole as (select found.channel, found.ix, list(t.v order by pos) as w
from found join snap on true join kept t on t.channel = found.channel and t.ix = found.ix + snap.at
group by 1, 2 having count(*) = {len(_SNAP)}),
fine as (select channel, ix, list_transform(range(0, {10 * len(_SNAP)}), lambda j: w[least(j // 10, {len(_SNAP) - 1}) + 1]
+ (w[least(j // 10 + 1, {len(_SNAP) - 1}) + 1] - w[least(j // 10, {len(_SNAP) - 1}) + 1]) * least(j * 0.1::double - least(j // 10, {len(_SNAP) - 1}),
1.0)) as w from whole),
spiked as (select channel, ix, low_at, w from (select *, list_position(w, list_min(w)) - 1 as low_at from fine)
where low_at >= {10 * _PRE} and low_at + {10 * _POST} <= {10 * len(_SNAP)})"""


@query(f"""with {_SORT}, n as (select channel, count(*) as n_spikes, sum(ix)::bigint as places, round(avg(list_min(w)), 4) as mean_low from spiked group by 1)
select cuts.channel, seconds, cutoff, round(threshold, 4) as threshold, coalesce(n_spikes, 0) as n_spikes, places, mean_low from cuts
left join limits on limits.channel = cuts.channel left join n on n.channel = cuts.channel""")
def sort_detection(spark, sf):
    """The first half of the sorting job: filter, cutoff, guard, threshold, snapshots and waveforms of all channels."""
    channels, spikes = so.detection(src.trace(spark, sf), SORT_SETTINGS, SORT_FS, times=SORT_TIMES)
    n = spikes.groupBy("channel").agg(F.count("*").alias("n_spikes"), F.sum("ix").alias("places"), F.avg(wf.amplitude(F.col("w"))).alias("mean_low"))
    return rounded(channels.join(n, "channel", "left").fillna(0, ["n_spikes"]), 4)


def _sorted(spark, sf):
    return so.sort_traces(src.trace(spark, sf), SORT_SETTINGS, SORT_FS, times=SORT_TIMES)


@query()
def sort_run(spark, sf):
    """The whole job from traces to units over the events' values: every cluster of every valid solution of every channel."""
    return rounded(_sorted(spark, sf).report, 4)


@query(f"""with {_SORT}, n as (select channel, count(*) as n_spikes from spiked
group by 1) select cuts.channel, cutoff, coalesce(n_spikes, 0) as n_spikes, 0::bigint as lost, 0::bigint as doubled,
case when cutoff < 60 then 'early cutoff' when n_spikes is null then 'no spikes' else 'clustered' end as state from cuts
left join n on n.channel = cuts.channel""")
def sort_accounts(spark, sf):
    """What the job makes of every spike: none is lost or doubled in the labels of a valid solution, whatever the fits are."""
    run = _sorted(spark, sf)
    each = run.labels.groupBy("channel", "k").agg(F.count("*").alias("n"), F.count_distinct("spike_id").alias("kinds"))
    worst = each.join(run.channels.select("channel", "n_spikes"), "channel").groupBy("channel").agg(F.max(F.col("n_spikes") - F.col("kinds")).alias("lost"), F.max(F.col("n") - F.col("kinds")).alias("doubled"))
    state = F.when(F.col("state").isin("sorted", "no solution"), "clustered").otherwise(F.col("state")).alias("state")
    return run.channels.join(worst, "channel", "left").fillna(0, ["lost", "doubled"]).select("channel", "cutoff", "n_spikes", "lost", "doubled", state)


@query(f"""with {PTS}, p as (select cluster, spike_id, pos, v from points where pos % 8 = 0),
m as (select cluster, pos, avg(v) as mv, count(*) as n from p group by 1, 2)
select a.cluster, a.pos::int as i, b.pos::int as j, count(*) as n, round(covar_samp(a.v, b.v), 6) + 0.0 as cov
from p a join p b on a.spike_id = b.spike_id and a.cluster = b.cluster and a.pos <= b.pos group by 1, 2, 3""")
def cluster_moments(spark, sf):
    """Sample covariances of every eighth sample of all clusters' waveforms, from one pass over all clusters."""
    rows = src.spikes(spark, sf).select("cluster", F.filter("w", lambda v, i: i % 8 == 0).alias("x"))
    m = mo.grouped_moments(rows, ["cluster"]).select("cluster", "n", F.posexplode("m2").alias("at", "s"), F.size("mean").alias("d"))
    i, j = F.expr("cast(at div d * 8 as int)"), F.expr("cast(at % d * 8 as int)")
    return rounded(m.where("at div d <= at % d").select("cluster", i.alias("i"), j.alias("j"), "n", (F.col("s") / (F.col("n") - 1)).alias("cov")))


@query(f"""with {PTS}, s as (select cluster, pos, var_pop(v) as var from points group by 1, 2),
r as (select cluster, row_number() over (partition by cluster order by var desc, pos) - 1 as component, var / sum(var) over (partition by cluster) as ratio
from s),
c as (select *, sum(ratio) over (partition by cluster order by component) as cumulative from r)
select cluster, component::int as component, round(ratio, 6) as ratio, round(cumulative, 6) as cumulative, (count(*) over (partition by cluster))::bigint as n
from c where cumulative - ratio <= 0.8""")
def variance_shares(spark, sf):
    """Sample places of each cluster's waveforms by their share of the variance, until the sum is above 0.8, and their number."""
    from pyspark.sql.window import Window

    s = src.spikes(spark, sf).select("cluster", F.posexplode("w").alias("pos", "v")).groupBy("cluster", "pos").agg(F.var_pop("v").alias("var"))
    rank = (F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("var"), "pos")) - 1).cast("int")  # one row a place
    ratios = s.select("cluster", rank.alias("component"), (F.col("var") / F.sum("var").over(Window.partitionBy("cluster"))).alias("ratio"))
    curve = cl.variance_curve(ratios, 0.8, ["cluster"])
    return rounded(curve.join(cl.component_count(ratios, 0.8, ["cluster"]), "cluster"))


@query()
def channel_components(spark, sf):
    """The principal components that count of each cluster's waveforms: shares of the variance, for all clusters in one job."""
    c = cl.channel_components(src.spikes(spark, sf), 0.5, channel="cluster")
    return rounded(c.select("cluster", "n", "n_pc", F.posexplode("ratios").alias("component", "ratio")).where("component < n_pc"), 5)


@query()
def pca_scores(spark, sf):
    s = cl.pca_scores(src.spikes(spark, sf).withColumn("w", wf.scaled(F.col("w"))), 3)
    return rounded(s.select("spike_id", *[F.abs(F.get("pcs", F.lit(i))).alias(f"pc{i}") for i in range(3)]), 4)


@query()
def pca_variance(spark, sf):
    """Shares of the variance until their sum is above 0.95."""
    _, model = cl.pca_model(src.spikes(spark, sf))
    ratios = spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.explainedVariance)], "component int, ratio double")
    return rounded(cl.variance_curve(ratios, 0.95))


@query()
def wavelet_selected(spark, sf):
    c = src.spikes(spark, sf).select("spike_id", F.posexplode(wf.haar(F.col("w"))).alias("k", "coef"))
    return rounded(cl.selected_coefficients(c), 5)


# Curation, status, catalog --------------------------------------------------------------------------------------------


def _active(spark, sf):
    t = src.train(spark, sf)
    return t.select("rec", F.substring("unit", 1, 1).alias("name"), (F.ascii("unit") % 7).alias("cluster"), F.col("id").alias("spike_id"), F.col("us").alias("t"))


_ACT = f"{TRN}, active as (select rec, unit[1] as name, (ascii(unit) % 7)::int as cluster, id as spike_id, us as t from train)"


@query(f"""with {_ACT} select case when cluster in (1, 3) then 99 else cluster end as cluster, count(*) as n, min(t) as first_t, max(t) as last_t from active
group by 1""")
def merge_clusters(spark, sf):
    return cu.merge(_active(spark, sf), [1, 3], 99).groupBy("cluster").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(f"with {_ACT} select case when cluster = 1 then cluster * 10 + rec else cluster end as cluster, count(*) as n from active group by 1")
def split_by_recording(spark, sf):
    return cu.split_by_recording(_active(spark, sf), 1).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"with {_ACT} select cluster, count(*) as n from active where cluster not in (1, 3) group by 1")
def discard_clusters(spark, sf):
    return cu.discard(_active(spark, sf), [1, 3]).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"with {_ACT} select rec, name, cluster, spike_id, t from active where spike_id not in (select vec_id from embeddings where label = 3)")
def delete_spikes(spark, sf):
    gone = src.spikes(spark, sf).where("cluster = 3").select("spike_id")
    return cu.delete_spikes(_active(spark, sf), gone).select("rec", "name", "cluster", "spike_id", "t")


@query(f"""with {_ACT}, g as (select unnest(range(0, 7)) as a, unnest(range(0, 7)) as dummy),
p as (select x.a, y.a as b from g x cross join g y where x.a <= y.a),
c as (select cluster, t, count(*) as n from active group by 1, 2)
select p.a::int as a, p.b::int as b, not exists (select 1 from (select * from c where cluster = p.a) x full join (select * from c
where cluster = p.b) y on x.t = y.t and x.n = y.n where x.t is null or y.t is null) as equal from p""")
def clusters_equal(spark, sf):
    """All pairs of clusters, each with itself too: whether they hold the same times as often."""
    c = _active(spark, sf).groupBy("cluster", "t").agg(F.count("*").alias("n"))
    pairs = spark.range(7).select(F.col("id").cast("int").alias("a")).withColumn("b", F.explode(F.sequence("a", F.lit(6))))
    sides = [c.join(pairs, c["cluster"] == pairs[side]).select("a", "b", "t", F.col("n") * sign) for side, sign in (("a", 1), ("b", -1))]
    differ = sides[0].union(sides[1]).toDF("a", "b", "t", "n").groupBy("a", "b", "t").agg(F.sum("n").alias("d")).groupBy("a", "b").agg(F.count_if(F.col("d") != 0).alias("d"))
    return pairs.join(differ, ["a", "b"], "left").select("a", "b", (F.coalesce("d", F.lit(0)) == 0).alias("equal"))


@query(f"""with {_ACT}, d as (select cluster, rec, (t - lag(t) over (partition by cluster, rec order by t)) / 60e6 as ms
from active) select cluster, count(*) as n, count(case when ms < 1 then 1 end) as v1, count(case when ms < 2 then 1 end) as v2 from d group by 1""")
def curation_summary(spark, sf):
    t = tr.intervals(_active(spark, sf).select("cluster", "rec", "t"), ["cluster", "rec"], "t", DAY)
    return tr.isi_violations(t, ["cluster"], F.col("isi") / 60e6).select("cluster", "n", "v1", "v2")


@query(f"""with {_ACT}, f as (select r_regionkey::int as cluster, r_regionkey = 1 as single, r_regionkey = 2 as pyramidal
from region) select active.cluster, single, pyramidal, count(*) as n from active join f on f.cluster = active.cluster group by 1, 2, 3""")
def saved_units(spark, sf):
    flags = src.table(spark, sf, "region").select(F.col("r_regionkey").alias("cluster"), (F.col("r_regionkey") == 1).alias("single"), (F.col("r_regionkey") == 2).alias("pyramidal"))
    units, _ = cu.save_units(_active(spark, sf), flags)
    return units.groupBy("cluster", "single", "pyramidal").agg(F.count("*").alias("n"))


_LAB = "lab as (select event_type as channel, s.solution::int as solution, (user_id % s.solution)::int as cluster, event_id as spike_id from events cross join (select unnest(range(2, 5)) as solution) s)"


def _solutions(spark, sf):
    e = src.table(spark, sf, "events").select(F.col("event_type").alias("channel"), "user_id", F.col("event_id").alias("spike_id"))
    return e.withColumn("solution", F.explode(F.sequence(F.lit(2), F.lit(4)))).select("channel", "solution", (F.col("user_id") % F.col("solution")).cast("int").alias("cluster"), "spike_id")


@query(f"""with {_LAB} select channel, solution, cluster, spike_id from lab where channel = (select min(event_type)
from events) and solution = 3 and cluster in (0, 2)""")
def solution_clusters(spark, sf):
    """Two clusters of a stored solution of the first channel."""
    first = src.table(spark, sf, "events").agg(F.min("event_type")).first()[0]
    return cu.solution_clusters(_solutions(spark, sf), first, 3, [0, 2])


@query(f"""with {_ACT}, p as (select id, case when rec < 2 then 0 when rec = 2 then 1 end as part from train)
select case when cluster = 1 then 10 + part else cluster end as cluster, count(*) as n from active join p on p.id = spike_id where cluster <> 1 or part = 1
group by 1""")
def split_committed(spark, sf):
    """Cluster 1 split in parts by recording, the second part kept."""
    a = _active(spark, sf)
    labels = a.where("cluster = 1").select("spike_id", F.when(F.col("rec") < 2, 0).when(F.col("rec") == 2, 1).alias("part"))
    return cu.commit_split(a, labels, 1, [1]).groupBy("cluster").agg(F.count("*").alias("n"))


@query("""select event_type as cluster, count(case when user_id % 5 > 3 then 1 end) as no_rec, count(case
when value is null then 1 end) as no_time, count(case when e.vec_id is null then 1 end) as no_wave
from events left join embeddings e on e.vec_id = event_id group by 1
having count(case when user_id % 5 > 3 then 1 end) + count(case when value is null then 1 end) + count(case when e.vec_id is null then 1 end) > 0""")
def invalid_clusters(spark, sf):
    """Clusters with spikes that a map of four recordings, the times or the waveforms lack."""
    waves = src.spikes(spark, sf).select("spike_id", "w")
    e = src.table(spark, sf, "events").select(F.col("event_type").alias("cluster"), (F.col("user_id") % 5).alias("rec"), F.col("event_id").alias("spike_id"), F.col("value").alias("t"))
    return cu.invalid_clusters(e.join(waves, "spike_id", "left"), spark.range(4).toDF("rec"))


@query("""select r_regionkey as rec, case when r_regionkey % 2 = 0 then '/new/place/' || r_name || '.h5' else '/old/' || r_name || '.h5' end as path
from region""")
def rerooted_recordings(spark, sf):
    r = src.table(spark, sf, "region")
    recordings = r.select(F.col("r_regionkey").alias("rec"), F.concat(F.lit("/old/"), "r_name", F.lit(".h5")).alias("path"))
    return cu.rerooted(recordings, r.where("r_regionkey % 2 = 0").select(F.concat(F.lit("/new/place/"), "r_name", F.lit(".h5")).alias("path")))


@query("select (user_id % 5)::int as rec, bool_and(coalesce(value > 0.5, false)) as complete from events group by 1")
def detection_complete(spark, sf):
    return cu.detection_complete(src.table(spark, sf, "events").select((F.col("user_id") % 5).cast("int").alias("rec"), F.col("event_type").alias("channel"), (F.col("value") > 0.5).alias("done")))


@query("""with grid as (select c.channel, k::int as k from (select distinct event_type as channel from events) c cross join (select unnest(range(2, 8)) as k)),
done as (select event_type as channel, (user_id % 5 + 2)::int as k from events where value > 150)
select channel, k from grid where not exists (select 1 from done where done.channel = grid.channel and done.k = grid.k)""")
def pending_work(spark, sf):
    e = src.table(spark, sf, "events")
    grid = e.select(F.col("event_type").alias("channel")).distinct().withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(7))))
    done = e.where("value > 150").select(F.col("event_type").alias("channel"), (F.col("user_id") % 5 + 2).cast("int").alias("k"))
    return cu.missing(grid, done, ["channel", "k"])


@query("select distinct (user_id % 5)::int as rec, event_type as channel from events")
def catalog(spark, sf):
    return src.table(spark, sf, "events").select((F.col("user_id") % 5).cast("int").alias("rec"), F.col("event_type").alias("channel")).distinct()


@query("select event_type as channel, count(*) as n from events where contains(lower(event_type), 'u') group by 1")
def channels_named(spark, sf):
    e = src.table(spark, sf, "events").where(F.lower("event_type").contains("u"))
    return e.groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))


@query("select e.event_id, coalesce(r.value, e.value) as v from events e left join (select event_id, value from events where user_id % 2 = 0) r on r.event_id = e.event_id")
def referenced_or_raw(spark, sf):
    e = src.table(spark, sf, "events").select("event_id", "user_id", "value")
    ref = e.where("user_id % 2 = 0").select("event_id", F.col("value").alias("ref"))
    return e.join(ref, "event_id", "left").select("event_id", F.coalesce("ref", "value").alias("v"))


@query(f"""with {TRN}, m as (select unit, median(t - floor(t / 1440) * 1440) as mid from train
group by 1) select unit, round(mid, 4) as median_t, rank() over (order by mid)::int as place from m""")
def ensemble_order(spark, sf):
    from pyspark.sql.window import Window

    mid = quantiles(src.train(spark, sf), ["unit"], F.col("t") - F.floor(F.col("t") / 1440) * 1440, {"mid": 0.5})
    return rounded(mid.select("unit", F.col("mid").alias("median_t"), F.rank().over(Window.orderBy("mid")).alias("place")), 4)  # one row a unit


_G25 = tr.gaussian_weights(25.0)


@query(f"""with {TRN}, ones as (select distinct unit, round_even(t / 60.0, 0)::bigint as bin from (select unit, t - min(t) over () as t from train)),
ends as (select max(bin) as last from ones),
grid as (select u.unit, unnest(range(0, last + 1)) as bin, last + 1 as n from (select distinct unit from ones) u, ends),
full_rows as (select g.unit, g.bin, n, (o.bin is not null)::int as v from grid g left join ones o on o.unit = g.unit and o.bin = g.bin),
w as (select unnest({[k - len(_G25) // 2 for k in range(len(_G25))]}) as k, unnest({[float(x) for x in _G25]}) as weight),
near as (select r.unit, r.bin, weight, ((r.bin + k) % (2 * n) + 2 * n) % (2 * n) as p, n from full_rows r cross join w)
select near.unit, near.bin, round(sum(weight * f.v), 5) as value
from near join full_rows f on f.unit = near.unit and f.bin = case when p < near.n then p else 2 * near.n - 1 - p end group by 1, 2""")
def ensemble_raster(spark, sf):
    """Which hours of the session each unit is active in, smoothed over 25 hours: a series of any length in blocks."""
    first = src.train(spark, sf).agg(F.min("t").alias("first"))
    times = src.train(spark, sf).crossJoin(F.broadcast(first)).select("unit", ((F.col("t") - F.col("first")) / 60.0).alias("hours"))
    return rounded(tr.ensemble_raster(times, "hours", 1.0, 25.0)[0], 5)


@query(f"with {AE} select cluster, round(quantile_cont(amplitude, 0.95), 6) as p95 from ae group by 1")
def held_unit_percentile(spark, sf):
    return rounded(quantiles(with_shape(spark, sf), ["cluster"], F.col("amplitude"), {"p95": 0.95}))


_J3 = f"""{AE}, pairs as (select a.cluster = b.cluster as own, abs(a.amplitude - b.amplitude) as v from ae a join ae b on a.spike_id + 1 = b.spike_id),
ends as (select min(v) as lo, max(v) as hi from pairs)"""


def _alike(spark, sf):
    s = with_shape(spark, sf).select("spike_id", "cluster", "amplitude")
    after = s.select((F.col("spike_id") - 1).alias("spike_id"), F.col("cluster").alias("c"), F.col("amplitude").alias("x"))
    pairs = s.join(after, "spike_id").select((F.col("cluster") == F.col("c")).alias("own"), F.abs(F.col("amplitude") - F.col("x")).alias("v"))
    return tr.held_criterion(pairs.where("own"), pairs.where("not own"), "v", 80.0)


@query(f"""with {_J3} select k::int as bin, round(lo + k * (hi - lo) / 20, 6) as start, count(case when own then 1 end) as within, count(case
when not own then 1 end) as across
from (select unnest(range(0, 20)) as k), ends left join pairs on least(floor((v - lo) / ((hi - lo) / 20)), 19) = k group by k, lo, hi""")
def held_pairs_histogram(spark, sf):
    """How alike pairs of neighbouring spikes are within a unit and across units, in equal bins over both."""
    return rounded(_alike(spark, sf)[0])


@query(f"""with {_J3}, c as (select quantile_cont(v, 0.8) as x from pairs where own) select round(x, 6) as "at", (select count(*) from pairs, c
where not own and v <= x) as held from c""")
def held_criterion(spark, sf):
    """The percentile of pairs within a unit, and how many pairs across units lie at or below it."""
    return rounded(_alike(spark, sf)[1])


@query(f"""with {SPK}, p as (select spike_id, unnest(list_transform(w, lambda x: round(x, 1) + 0.0)) as v, unnest(range(0, len(w))) as pos from spikes),
g as (select *, pos - row_number() over (partition by spike_id, v order by pos) as grp from p),
flat as (select spike_id, v, min(pos) as a, max(pos) as b from g group by spike_id, v, grp),
n as (select *, lag(v) over o as before, lead(v) over o as after from flat window o as (partition by spike_id order by a))
select spike_id, ((a + b) // 2)::int as pos, v from n where v > before and v > after""")
def local_peaks(spark, sf):
    """All strict local maxima of waveforms in steps of a tenth, where many are plateaus, each at its middle."""
    s = src.spikes(spark, sf).select("spike_id", F.transform("w", lambda x: F.round(x, 1)).alias("w"))
    return s.select("spike_id", "w", F.explode(wf.local_peaks(F.col("w"))).alias("pos")).select("spike_id", "pos", F.get("w", F.col("pos")).alias("v"))


@query(f"""with {SPK}, e as (select spike_id, unnest(w) as v, generate_subscripts(w, 1) as i from spikes),
d as (select a.spike_id as a, b.spike_id as b, sqrt(sum((a.v - b.v) * (a.v - b.v))) as d from e a join e b on a.i = b.i and a.spike_id <> b.spike_id
group by 1, 2),
r as (select *, row_number() over (partition by a order by d, b) as k from d) select a as spike_id, k::int as place, round(d, 5) as distance from r
where k <= 5""")
def nearest_neighbours(spark, sf):
    """The distances of each spike's nearest five others, each compared with all."""
    from pyspark.sql.window import Window

    graph = ne.exact_graph(src.spikes(spark, sf), "spike_id", "w", 5)
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))  # five rows a spike
    return rounded(graph.select(F.col("a").alias("spike_id"), place.alias("place"), F.col("d").alias("distance")), 5)


@query()
def neighbour_layout(spark, sf):
    """A layout of all spikes from their neighbour graph: how far they spread along each axis."""
    at = ne.reduced(src.spikes(spark, sf), "neighbours", 2, k=8).select("cluster", "spike_id", F.posexplode("at").alias("axis", "v"))
    return rounded(at.groupBy("axis").agg(F.count("*").alias("n"), F.avg(F.col("v") * F.col("v")).alias("spread")), 9)


_SMOOTH = f"""w as (select unnest({[k - len(_W) // 2 for k in range(len(_W))]}) as k, unnest({[float(x) for x in _W]}) as weight),
r as (select unit, trial, center, rate, row_number() over (partition by unit, trial order by center) - 1 as ix from rates),
smooth as (select r.unit, r.trial, r.center, sum(weight * o.rate) as rate
from r cross join w join r o on o.unit = r.unit and o.trial = r.trial and o.ix = {_MIRROR.replace('ix', 'r.ix')} group by 1, 2, 3)"""


@query(f"""with {_RATES}, {_SMOOTH}, m as (select unit, center, avg(rate) as rate, count(*) as trials from smooth group by 1, 2)
select unit, center, round(case when unit = 'click' then 2 else 1 end * rate, 4) as rate, trials from m""")
def psth_store(spark, sf):
    """Smoothed rates and their unit means in a run folder, by unit; one unit's are stored anew and replace what it had."""
    folder, rates = runs.scratch_folder(spark, "psth"), tr.smoothed(_rates(spark, sf), ["unit", "trial"])
    runs.store_rates(folder, rates)
    runs.store_rates(folder, rates.where("unit = 'click'").withColumn("rate", F.col("rate") * 2))
    return rounded(folder.read("mean_rates").select("unit", "center", "rate", "trials"), 4)


# Run folders and versions ---------------------------------------------------------------------------------------------


@query(f"""with {_ACT}, merged as (select *, case when cluster in (1, 3) then 99 when cluster = 0 then rec else cluster end as now from active)
select 'active' as what, now::varchar as name, count(*) as n, sum(t % 1000)::bigint as check_t from merged where now <> 99 or cluster = 0 group by 1, 2
union all select 'unit', 'unit000', count(*), sum(t % 1000)::bigint from merged where now = 99 and cluster <> 0
union all select 'log', string_agg(action, ',' order by k), count(*), 0::bigint
from (select unnest(['start', 'edit', 'edit', 'undo', 'edit', 'save', 'undo', 'save']) as action, unnest(range(0, 8)) as k)""")
def version_fold(spark, sf):
    """A curation session on disk: merge, discard, undo of that, split by recording, a save, its undo, the save again."""
    path = runs.scratch_folder(spark, "versions").path
    v = runs.Versions(spark, path)
    v.start(_active(spark, sf))
    v.edit("merge", cu.merge(v.spikes(), [1, 3], 99))
    v.edit("discard", cu.discard(v.spikes(), [6]))
    v.undo()
    runs.Versions(spark, path).edit("split", cu.split_by_recording(v.spikes(), 0))  # as another session would
    v.save("keep", [99, 6], [True, False], [False, False], [False, True])
    v.undo()
    v.save("keep", [99], [True], [False], [False])
    count = lambda df, what, name: df.groupBy(F.lit(what).alias("what"), F.col(name).cast("string").alias("name")).agg(F.count("*").alias("n"), F.sum(F.col("t") % 1000).alias("check_t"))
    actions = [r["action"] for r in v.log()]
    log = spark.createDataFrame([("log", ",".join(actions), len(actions), 0)], "what string, name string, n long, check_t long")
    return count(v.spikes(), "active", "cluster").union(count(v.units(), "unit", "unit")).union(log)


@query(f"""with {TRC}, n as (select channel, count(*) as n from trace group by 1)
select channel, case when n % 2 = 0 then 'done' when n % 3 = 0 then 'failed' else 'started' end as state, case when n % 2 = 0 then 'two'
when n % 3 = 0 then 'three' else 'one' end as run, n % 2 <> 0 as pending from n""")
def run_status(spark, sf):
    """The latest state of each channel in a run folder's log, and what a later run still has to do."""
    n = src.trace(spark, sf).groupBy("channel").agg(F.count("*").alias("n"))
    folder = runs.scratch_folder(spark, "status")
    folder.note(n.select("channel", F.lit("started").alias("state")), "sort", "one")
    folder.note(n.where("n % 2 = 0").select("channel", F.lit("done").alias("state")), "sort", "two")
    folder.note(n.where("n % 2 <> 0 and n % 3 = 0").select("channel", F.lit("failed").alias("state")), "sort", "three")
    todo = folder.pending(n, "sort").select("channel", F.lit(True).alias("pending"))
    return folder.status().select("channel", "state", "run").join(todo, "channel", "left").fillna(False, ["pending"])


@query(f"""with {SPK}, k as (select cluster, count(*) as n from spikes group by 1),
one as (select cluster, row_number() over (order by cluster) - 1 as place from k),
two as (select cluster, row_number() over (order by cluster) - 1 + (select count(*) from k) as place from k where cluster % 2 = 0)
select run, unit, cluster, n from (select 'one' as run, printf('unit%03d', place) as unit, cluster from one
union all select 'two', printf('unit%03d', place), cluster from two) join k using (cluster)""")
def unit_names(spark, sf):
    """The units of two runs, one of which was tried twice: named without gaps, appended once."""
    spikes = src.spikes(spark, sf).select("spike_id", "cluster")
    folder = runs.scratch_folder(spark, "units")
    for run, part in (("one", spikes), ("two", spikes.where("cluster % 2 = 0")), ("two", spikes.where("cluster % 2 = 0"))):
        runs.append_units(folder, part, run)
    return folder.read("run_units").groupBy("run", "unit", "cluster").agg(F.count("*").alias("n"))


@query(f"""with {SPK}, f as (select distinct cluster from spikes where cluster % 3 = 0),
g as (select cluster, unnest([2, 3]) as k from (select distinct cluster from spikes))
select cluster::varchar as channel, g.k::int as k, coalesce(n, 0)::bigint as n, round(coalesce(m, 0), 6) as m, n is null as missing from g
left join (select cluster, k, n, m from (select cluster, count(*) as n, avg(w[1]) as m from spikes group by 1) x, (select unnest([2, 3]) as k) y
where not (k = 3 and cluster % 3 = 0)) q using (cluster, k)""")
def report_files(spark, sf):
    """Report files of channels and solutions, read back with those that are missing."""
    rows = src.spikes(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"), F.avg(F.get("w", F.lit(0))).alias("m"))
    rows = rows.select(F.col("cluster").cast("string").alias("channel"), F.explode(F.array(F.lit(2), F.lit(3))).alias("k"), "n", "m")
    path = runs.scratch_folder(spark, "reports").path
    runs.write_reports(rows.where("not (k = 3 and int(channel) % 3 = 0)"), path)
    found, missing, _ = runs.read_reports(spark, path, "n long, m double", rows)
    gone = missing.select("channel", "k", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("m"), F.lit(True).alias("missing"))
    return rounded(found.select("channel", "k", "n", "m", F.lit(False).alias("missing")).union(gone))
