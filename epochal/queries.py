"""Registered queries of the signal operators, each with the same query in SQL.

The stand-ins: a user's events, ordered by time, are a recording; ``signup`` rows are
triggers; ``value`` is the signal; embeddings are feature vectors; lineitem rows make
label images and responses by direction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.functions import cell_types, scalars
from epochal.operators import algebra, epochs, features, learning, masks, mixtures, receptive, segmentation, series
from epochal.sources import logs, paths, stimuli
from epochal.streaming import incremental

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def samples(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events").select("user_id", "event_id", "event_type", "value", MICROS.alias("us"))
    return series.indexed(e, "user_id", ["us", "event_id"], "value").drop("value")


class _Micros:
    """Microseconds since 1970 of ``ts`` as written, whatever the session's time zone."""

    @staticmethod
    def alias(name: str):
        return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias(name)


MICROS = _Micros()


def is_signup():
    return F.col("event_type") == "signup"


def r6(c, alias: str, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n).alias(alias)


BASE = """s AS (SELECT user_id, event_id, event_type, value::DOUBLE AS v, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
EPOCH = (
    BASE
    + """, tr AS (SELECT user_id, i AS start, n, lead(i) OVER (PARTITION BY user_id ORDER BY i) - i AS d FROM s WHERE event_type = 'signup'),
k AS (SELECT *, coalesce(floor(median(d::DOUBLE) OVER (PARTITION BY user_id))::INTEGER, n - start + 1) AS k FROM tr),
st AS (SELECT user_id, start, k, row_number() OVER (PARTITION BY user_id ORDER BY start) AS rep FROM k WHERE start + k - 1 <= n),
sn AS (SELECT st.user_id, st.rep, s.i - st.start AS t, s.v FROM st JOIN s ON s.user_id = st.user_id AND s.i >= st.start AND s.i < st.start + st.k)"""
)
AVG = EPOCH + ", av AS (SELECT user_id, t, avg(v) AS average, count(*) AS reps FROM sn GROUP BY ALL HAVING count(*) > 1)"


def snips(s, d):
    x = samples(s, d)
    return epochs.snippets(x, epochs.epoch_starts(x, "user_id", is_signup()), "user_id")


def avgs(s, d):
    return epochs.averages(snips(s, d), "user_id")


# Relational algebra


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def restrict_dict(s, d):
    return algebra.restrict(t(s, d, "orders"), {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "unknown": 1}).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
def restrict_sql(s, d):
    return algebra.restrict(algebra.restrict(t(s, d, "orders"), "o_totalprice > 1000"), "o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR l_quantity > 45")
def restrict_or(s, d):
    return algebra.restrict(t(s, d, "lineitem"), [{"l_returnflag": "R"}, "l_quantity > 45"]).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_restrict(s, d):
    o = algebra.project(t(s, d, "orders"), [], c_custkey="o_custkey")
    return algebra.restrict(t(s, d, "customer").select("c_custkey", "c_name"), o)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_restrict(s, d):
    o = algebra.project(t(s, d, "orders"), [], c_custkey="o_custkey")
    return algebra.anti(t(s, d, "customer").select("c_custkey", "c_name"), o)


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' OR o_totalprice < 500)")
def anti_restrict_list(s, d):
    return algebra.anti(t(s, d, "orders"), [{"o_orderstatus": "O"}, "o_totalprice < 500"]).select("o_orderkey")


@query("SELECT n_nationkey AS nation, r_regionkey AS region, n_name, r_name, s_suppkey FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def natural_join(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), "n_name")
    r = t(s, d, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    u = t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return algebra.natural_join(algebra.natural_join(n, r), u)


@query("SELECT s_suppkey, p.preprocess_id, p.window_length FROM supplier, (VALUES (1, 60), (2, 30)) p(preprocess_id, window_length)")
def key_param_cross(s, d):
    return algebra.with_params(t(s, d, "supplier").select("s_suppkey"), [{"preprocess_id": 1, "window_length": 60}, {"preprocess_id": 2, "window_length": 30}])


@query("""WITH u AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT a.user_id, a.n AS n_click, b.n AS n_view FROM u a JOIN u b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def role_self_join(s, d):
    u = t(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return algebra.roles(u, ["user_id"], ({"event_type": "click"}, {"n_click": "n"}), ({"event_type": "view"}, {"n_view": "n"}))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def populate_missing_keys(s, d):
    done = t(s, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return algebra.anti(t(s, d, "orders").select("o_orderkey"), done)


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id) AS r FROM events) WHERE r = 1""")
def first_by_rank(s, d):
    e = t(s, d, "events").withColumn("rank", F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2))
    return algebra.best(e, ["user_id"], "rank", "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT n_nationkey AS k, 'new' AS v FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 3""")
def upsert_rows(s, d):
    old = t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return algebra.upsert(old, old.where("k < 3").select("k", F.lit("new").alias("v")), ["k"])


@query("SELECT n_nationkey AS k, n_name AS v FROM nation")
def insert_skip_duplicates(s, d):
    all_ = t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return algebra.insert(all_.where("k < 10"), all_, ["k"], skip_duplicates=True)


@query("SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS o_orderstatus FROM orders GROUP BY 1")
def unique_one(s, d):
    return algebra.unique_one(t(s, d, "orders"), ["o_custkey"], "o_orderstatus")


@query("""SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey > 1""")
def set_intersect(s, d):
    return t(s, d, "nation").select(F.col("n_regionkey").alias("k")).intersect(t(s, d, "region").where("r_regionkey > 1").select(F.col("r_regionkey").alias("k")))


# Aggregates


@query("""SELECT l_suppkey, count(*) AS n, round(median(l_quantity::DOUBLE), 6) AS med, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high,
round(avg(CASE WHEN l_quantity >= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM lineitem GROUP BY 1""")
def presentation_quality(s, d):
    q = F.col("l_quantity")
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.percentile(q, F.lit(0.5)), 6).alias("med"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"),
        F.round(F.avg(F.when(q >= 25, 1.0).otherwise(0.0)), 6).alias("share"),
    )


@query("""SELECT l_suppkey, round(quantile_cont(l_extendedprice::DOUBLE, 0.025::DOUBLE), 4) AS p025, round(quantile_cont(l_extendedprice::DOUBLE, 0.8::DOUBLE), 4) AS p80,
round(median(abs(l_extendedprice::DOUBLE)) / 0.6745::DOUBLE, 4) AS sigma FROM lineitem GROUP BY 1""")
def percentile_family(s, d):
    v = F.col("l_extendedprice")
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.percentile(v, F.lit(0.025)), 4).alias("p025"), F.round(F.percentile(v, F.lit(0.8)), 4).alias("p80"), F.round(F.percentile(F.abs(v), F.lit(0.5)) / F.lit(0.6745), 4).alias("sigma"))


@query("""WITH m AS (SELECT avg(s_acctbal) AS a, stddev_pop(s_acctbal) AS b FROM supplier) SELECT s_suppkey, s_acctbal FROM supplier, m WHERE abs(s_acctbal - a) <= 1.5::DOUBLE * b""")
def sigma_filter(s, d):
    u = t(s, d, "supplier").select("s_suppkey", "s_acctbal")
    m = u.agg(F.avg("s_acctbal").alias("a"), F.stddev_pop("s_acctbal").alias("b"))  # one row
    return u.crossJoin(F.broadcast(m)).where("abs(s_acctbal - a) <= 1.5D * b").select("s_suppkey", "s_acctbal")


# Series


def _norm(kind: str, sql: str):
    def f(s, d):
        return series.normalise(samples(s, d), "user_id", kind).select("event_id", r6(kind, "x"))

    f.__name__ = f"normalize_{kind}"
    query(f"WITH {BASE} SELECT event_id, round({sql}, 6) AS x FROM s")(f)


W = "OVER (PARTITION BY user_id)"
_norm("zscore", f"CASE WHEN stddev_pop(v) {W} = 0 THEN 0 ELSE (v - avg(v) {W}) / stddev_pop(v) {W} END")
_norm("zero_one", f"CASE WHEN max(v) {W} = min(v) {W} THEN 0 ELSE (v - min(v) {W}) / (max(v) {W} - min(v) {W}) END")
_LO, _HI = f"quantile_cont(v, 0.05::DOUBLE) {W}", f"quantile_cont(v, 0.95::DOUBLE) {W}"
_norm("soft_zero_one", f"greatest(0, least(1, CASE WHEN {_HI} = {_LO} THEN 0 ELSE (v - {_LO}) / ({_HI} - {_LO}) END))")
_norm("amp_one", f"CASE WHEN max(abs(v)) {W} = 0 THEN 0 ELSE v / max(abs(v)) {W} END")
_norm("std_one", f"CASE WHEN stddev_pop(v) {W} = 0 THEN 0 ELSE v / stddev_pop(v) {W} END")


@query(f"WITH {BASE} SELECT event_id, round(greatest(v - coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY i), v), 0), 6) AS dv FROM s")
def diff_positive_gradient(s, d):
    return series.difference(samples(s, d), "user_id", True).select("event_id", r6("dv", "dv"))


@query(f"""WITH {BASE}, p AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, median(abs(v)) {W} / 0.6745::DOUBLE AS sg FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT event_id, CASE WHEN v > a AND v > b AND v >= sg THEN v ELSE 0 END AS peak FROM p""")
def robust_sigma_events(s, d):
    return series.robust_events(samples(s, d), "user_id").select("event_id", "peak")


FIRST = BASE + ", f AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN i END) OVER (PARTITION BY user_id) AS st FROM s)"


def _first(s, d):
    return samples(s, d).withColumn("st", F.min(F.when(is_signup(), F.col("i"))).over(series.over("user_id")))


@query(f"WITH {FIRST} SELECT event_id, round(v - coalesce(median(CASE WHEN i < st - 1 THEN v END) {W}, 0), 6) AS vb FROM f")
def baseline_subtract(s, d):
    return series.baseline_subtract(_first(s, d), "user_id", "st").select("event_id", r6("vb", "vb"))


@query(f"WITH {FIRST} SELECT event_id, round(CASE WHEN stddev_pop(CASE WHEN i < st - 1 THEN v END) {W} = 0 THEN NULL ELSE v / stddev_pop(CASE WHEN i < st - 1 THEN v END) {W} END, 4) AS vs FROM f")
def standardize_baseline(s, d):
    return series.standardise_baseline(_first(s, d), "user_id", "st").select("event_id", r6("vs", "vs", 4))


_A, _B = f"quantile_cont(v, 0.025::DOUBLE) {W}", f"quantile_cont(v, 0.8::DOUBLE) {W}"


@query(f"WITH {BASE} SELECT event_id, round(CASE WHEN {_B} - {_A} <= 0 THEN v ELSE (v - {_A}) / ({_B} - {_A}) END, 6) AS dff FROM s")
def dff(s, d):
    return series.dff(samples(s, d), "user_id").select("event_id", r6("dff", "dff"))


@query(f"WITH {BASE} SELECT event_id, round(greatest(v - {_A}, 0), 6) AS vp FROM s")
def non_negative(s, d):
    return series.non_negative(samples(s, d), "user_id").select("event_id", r6("vp", "vp"))


@query(f"""WITH {BASE}, a AS (SELECT *, min(CASE WHEN i > 3 AND i <= n - 3 THEN v END) {W} AS lo, max(CASE WHEN i > 3 AND i <= n - 3 THEN v END) {W} AS hi FROM s),
b AS (SELECT *, coalesce(min(CASE WHEN i <= 3 AND NOT (v < lo OR v > hi) THEN i END) {W}, 4) AS l, coalesce(max(CASE WHEN i > n - 3 AND NOT (v < lo OR v > hi) THEN i END) {W}, n - 3) AS r FROM a)
SELECT b.event_id, CASE WHEN b.n <= 6 THEN b.v WHEN b.i < b.l THEN x.v WHEN b.i > b.r THEN y.v ELSE b.v END AS vr
FROM b LEFT JOIN s x ON x.user_id = b.user_id AND x.i = b.l LEFT JOIN s y ON y.user_id = b.user_id AND y.i = b.r""")
def edge_repair(s, d):
    return series.edge_repair(samples(s, d), "user_id").select("event_id", F.col("vr"))


@query(f"""WITH {BASE}, d AS (SELECT user_id, (us - lag(us) OVER (PARTITION BY user_id ORDER BY i))::DOUBLE AS d FROM s),
g AS (SELECT user_id, avg(d) AS dt, max(d) AS x, min(d) AS m FROM d GROUP BY 1) SELECT user_id, round(dt, 2) AS dt, round(greatest(x - dt, dt - m) / dt, 6) AS rel_error FROM g""")
def mean_step(s, d):
    return series.mean_step(samples(s, d), "user_id", "us").select("user_id", r6("dt", "dt", 2), r6("rel_error", "rel_error"))


@query(f"WITH {BASE} SELECT user_id, (i - 1) // 4 AS block, round(avg(v), 6) AS v FROM s GROUP BY 1, 2 HAVING count(*) = 4")
def block_downsample(s, d):
    return series.block_mean(samples(s, d), "user_id", 4).select("user_id", "block", r6("v", "v"))


@query(f"WITH {BASE} SELECT user_id, i, v, unnest(range(3))::INTEGER AS sub FROM s")
def upsample_repeat(s, d):
    return series.repeat_up(samples(s, d), "user_id", 3).select("user_id", F.col("i").cast("long"), "v", "sub")


@query(f"""WITH {BASE}, x AS (SELECT user_id, i, v, coalesce(lead(v) OVER (PARTITION BY user_id ORDER BY i), v) AS w, unnest(range(3)) AS sub FROM s)
SELECT user_id, i, sub::INTEGER AS sub, round(v + (w - v) * sub / 3::DOUBLE, 6) AS v FROM x""")
def upsample_linear(s, d):
    return series.linear_up(samples(s, d), "user_id", 3).select("user_id", F.col("i").cast("long"), "sub", r6("v", "v"))


DAY = 86_400_000_000


@query(f"""WITH {BASE}, b AS (SELECT user_id, v, us - min(us) {W} AS r, lead(us) OVER w - min(us) {W} AS nx, lead(v) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
g AS (SELECT *, unnest(range((r + {DAY} - 1) // {DAY}, CASE WHEN nx IS NULL THEN r // {DAY} + 1 ELSE (nx + {DAY} - 1) // {DAY} END)) AS g FROM b)
SELECT user_id, g, round(CASE WHEN nx IS NULL THEN v ELSE v + (v1 - v) * (g * {DAY} - r)::DOUBLE / (nx - r)::DOUBLE END, 6) AS v FROM g""")
def linear_resample(s, d):
    return series.resample(samples(s, d), "user_id", "us", DAY).select("user_id", "g", r6("v", "v"))


def _savgol_sql() -> str:
    from epochal.functions.kernels import savgol_weights

    terms = " + ".join(f"({float(c)!r}::DOUBLE) * coalesce({f'lead(v, {k}) OVER w' if k > 0 else f'lag(v, {-k}) OVER w' if k else 'v'}, {'l' if k > 0 else 'f'})" for k, c in zip(range(-3, 4), savgol_weights(3, 2), strict=True))
    return f"""WITH {BASE}, e AS (SELECT *, first_value(v) OVER x AS f, last_value(v) OVER x AS l FROM s WINDOW x AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_id, round({terms}, 4) AS trend FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)"""


@query(_savgol_sql())
def savgol_detrend(s, d):
    return series.savgol_detrend(samples(s, d), "user_id", 3, 2).select("event_id", r6("trend", "trend", 4))


@query()
def lowpass_trace(s, d):
    from epochal.functions.kernels import lowpass

    def run(pdf):
        return pdf.assign(low=lowpass(pdf["v"].to_numpy(), 8.0, 1.0) if len(pdf) > 1 else pdf["v"])[["user_id", "event_id", "low"]]

    return series.by_kernel(samples(s, d), "user_id", run, "user_id long, event_id long, low double")


@query(f"WITH {BASE} SELECT event_id, round(greatest(-7, least(7, CASE WHEN stddev_pop(v) {W} = 0 THEN 0 ELSE v / stddev_pop(v) {W} END)), 6) AS vc FROM s")
def clip_unit(s, d):
    return series.clip_unit(samples(s, d), "user_id").select("event_id", r6("vc", "vc"))


# As-of joins and epochs


def _asof(how: str, sql: str):
    def f(s, d):
        e = t(s, d, "events").select("user_id", "event_id", "event_type", "value", MICROS.alias("us"))
        return epochs.asof(e.where(is_signup()).select("user_id", "event_id", "us"), e.where(F.col("event_type") == "click"), "user_id", "us", "value", how).select("event_id", (F.col("m_time") / 1e6).alias("m_time"), "m_value")

    f.__name__ = f"asof_{how}"
    query(f"""WITH e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us FROM events), g AS (SELECT user_id, event_id, us FROM e WHERE event_type = 'signup'),
c AS (SELECT user_id, us, value FROM e WHERE event_type = 'click') {sql}""")(f)


_asof("backward", "SELECT event_id, c.us / 1e6::DOUBLE AS m_time, c.value AS m_value FROM g ASOF LEFT JOIN c ON g.user_id = c.user_id AND g.us >= c.us")
_asof("forward", "SELECT event_id, c.us / 1e6::DOUBLE AS m_time, c.value AS m_value FROM g ASOF LEFT JOIN c ON g.user_id = c.user_id AND g.us <= c.us")
_asof("nearest", "SELECT event_id, us2 / 1e6::DOUBLE AS m_time, value AS m_value FROM (SELECT g.event_id, c.us AS us2, c.value, row_number() OVER (PARTITION BY g.event_id ORDER BY abs(g.us - c.us), c.us) AS r FROM g LEFT JOIN c ON g.user_id = c.user_id) WHERE r = 1")

DATED = [("2020-01-01", 20.0, None), ("2022-06-01", 50.0, 30.0), ("2023-03-15", None, 100.0)]


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders) SELECT o_orderkey,
CASE WHEN day >= DATE '2022-06-01' THEN 50.0::DOUBLE WHEN day >= DATE '2020-01-01' THEN 20.0::DOUBLE END AS setup1,
CASE WHEN day >= DATE '2023-03-15' THEN 100.0::DOUBLE WHEN day >= DATE '2022-06-01' THEN 30.0::DOUBLE END AS setup2 FROM o""")
def dated_lookup_ffill(s, d):
    o = t(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return epochs.ffill_lookup(o, DATED, "day", ["setup1", "setup2"]).select("o_orderkey", "setup1", "setup2")


@query(f"WITH {EPOCH} SELECT user_id, start, k, rep FROM st")
def epoch_starts(s, d):
    return epochs.epoch_starts(samples(s, d), "user_id", is_signup()).select("user_id", F.col("start").cast("long"), "k", F.col("rep").cast("long"))


@query(f"WITH {EPOCH} SELECT user_id, rep, t, v FROM sn")
def epochs_snippets(s, d):
    return snips(s, d).select("user_id", F.col("rep").cast("long"), F.col("t").cast("long"), "v")


@query(f"WITH {AVG} SELECT user_id, t, round(average, 6) AS average, reps FROM av")
def snippet_averages(s, d):
    return avgs(s, d).select("user_id", F.col("t").cast("long"), r6("average", "average"), "reps")


@query(f"""WITH {EPOCH}, a AS (SELECT user_id, var_pop(m) AS a FROM (SELECT user_id, t, avg(v) AS m FROM sn GROUP BY ALL) GROUP BY 1),
b AS (SELECT user_id, avg(x) AS b, count(*) AS reps FROM (SELECT user_id, rep, var_pop(v) AS x FROM sn GROUP BY ALL) GROUP BY 1)
SELECT user_id, round(CASE WHEN b <> 0 THEN a / b END, 6) AS qidx, round(1.0::DOUBLE / reps, 6) AS min_qidx FROM a JOIN b USING (user_id)""")
def repeat_qi(s, d):
    return epochs.repeat_qi(snips(s, d), "user_id").select("user_id", r6("qidx", "qidx"), r6("min_qidx", "min_qidx"))


@query(f"""WITH {EPOCH}, c AS (SELECT a.user_id, a.rep AS ra, b.rep AS rb, corr(a.v, b.v) AS c FROM sn a JOIN sn b ON a.user_id = b.user_id AND a.t = b.t AND a.rep < b.rep GROUP BY ALL)
SELECT user_id, round(avg(CASE WHEN isfinite(c) THEN c END), 6) AS rep_corr FROM c GROUP BY 1""")
def repeat_correlation(s, d):
    return epochs.repeat_correlation(snips(s, d), "user_id").select("user_id", r6("rep_corr", "rep_corr"))


@query(f"""WITH {BASE}, f AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS frame FROM s)
SELECT user_id, frame::BIGINT AS frame, round(avg(v), 6) AS v, count(*) AS samples FROM f WHERE frame > 0 GROUP BY 1, 2""")
def align_trace_to_stim(s, d):
    return epochs.align_to_stimulus(samples(s, d), "user_id", "us", is_signup()).select("user_id", "frame", r6("v", "v"), "samples")


_UP = BASE + ", u AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY i) AS b FROM s) WHERE v >= 100 AND b < 100)"


@query(f"WITH {_UP} SELECT user_id, event_id FROM u")
def trigger_edges(s, d):
    return epochs.rising_edges(samples(s, d), "user_id", 100.0).select("user_id", "event_id")


@query(f"WITH {_UP} SELECT user_id, event_id FROM (SELECT *, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS g FROM u) WHERE g IS NULL OR g >= 5")
def refractory_triggers(s, d):
    return epochs.rising_edges(samples(s, d), "user_id", 100.0, 5).select("user_id", "event_id")


@query(f"""WITH {BASE}, h AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM s WHERE v >= 60)
SELECT user_id, min(i) AS start, count(*) AS width, max(v) AS peak FROM h GROUP BY user_id, g""")
def pulse_islands(s, d):
    return epochs.pulses(samples(s, d), "user_id", 60.0).select("user_id", F.col("start").cast("long"), "width", "peak")


@query("""WITH g AS (SELECT user_id, min(ts) AS a, max(ts) AS b, min(CASE WHEN event_type = 'signup' THEN ts END) AS c, max(CASE WHEN event_type = 'signup' THEN ts END) AS d FROM events GROUP BY 1)
SELECT user_id, coalesce(c >= a AND d <= b, TRUE) AS valid FROM g""")
def valid_triggers(s, d):
    return epochs.valid_triggers(samples(s, d), "user_id", "us", is_signup())


# Receptive fields


@query(f"""WITH {BASE}, e AS (SELECT user_id, v AS y, i, CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM s),
l AS (SELECT user_id, y, k AS lag, coalesce(CASE k WHEN 0 THEN x WHEN 1 THEN lag(x, 1) OVER w WHEN 2 THEN lag(x, 2) OVER w WHEN 3 THEN lag(x, 3) OVER w END, 0) AS x
  FROM (SELECT e.*, unnest(range(4)) AS k FROM e) WINDOW w AS (PARTITION BY user_id, k ORDER BY i))
SELECT user_id, lag::INTEGER AS lag, round(sum(x * y) / sum(y), 6) AS w FROM l GROUP BY 1, 2""")
def sta_lagged(s, d):
    x = samples(s, d).withColumn("x", F.when(F.col("event_type") == "click", 1.0).otherwise(0.0))
    return features.sta(x, "user_id", "x", "v", 4).select("user_id", "lag", r6("w", "w"))


_RF = f"""{BASE}, e AS (SELECT user_id, event_id, n, v AS y, i, CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM s),
l AS (SELECT *, coalesce(lag(x, 1) OVER w, 0) AS x1, coalesce(lag(x, 2) OVER w, 0) AS x2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i)),
r AS (SELECT user_id, sum(x * y) / sum(y) AS w0, sum(x1 * y) / sum(y) AS w1, sum(x2 * y) / sum(y) AS w2 FROM l GROUP BY 1),
p AS (SELECT l.*, x * w0 + x1 * w1 + x2 * w2 AS pred FROM l JOIN r USING (user_id))"""


def _predicted(s, d):
    x = samples(s, d).withColumn("x", F.when(F.col("event_type") == "click", 1.0).otherwise(0.0))
    return features.predict(x, features.sta(x, "user_id", "x", "v", 3), "user_id", "x", 3)


@query(f"WITH {_RF} SELECT event_id, round(pred, 6) AS pred FROM p")
def predict_linear(s, d):
    return _predicted(s, d).select("event_id", r6("pred", "pred"))


@query(f"""WITH {_RF} SELECT user_id, CASE WHEN abs(1 - var_pop(y - pred) / var_pop(y)) < 1e-6 THEN 0.0::DOUBLE WHEN var_pop(y) <> 0 THEN round(1 - var_pop(y - pred) / var_pop(y), 6) END AS explained, CASE WHEN abs(corr(y, pred)) < 1e-6 THEN 0.0::DOUBLE ELSE round(corr(y, pred), 6) END AS cc, round(avg((y - pred) * (y - pred)), 5) AS mse FROM p GROUP BY 1 HAVING stddev_pop(pred) > 0""")
def explained_variance(s, d):
    p = _predicted(s, d)
    ok = p.groupBy("user_id").agg(F.stddev_pop("pred").alias("sd")).where("sd > 0").select("user_id")
    return features.explained_variance(p.join(ok, "user_id", "left_semi"), "user_id", "v", "pred").select("user_id", F.when(F.abs("explained") < 1e-6, F.lit(0.0)).otherwise(F.round("explained", 6)).alias("explained"), F.when(F.abs("cc") < 1e-6, F.lit(0.0)).otherwise(F.round("cc", 6)).alias("cc"), r6("mse", "mse", 5))


@query(f"""WITH {BASE} SELECT user_id, CASE WHEN i <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.9::DOUBLE) THEN 'dev' ELSE 'test' END AS part, count(*) AS samples FROM s GROUP BY 1, 2""")
def split_fractions(s, d):
    return features.split(samples(s, d)).groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("samples"))


# Response features


@query("""WITH a AS (SELECT l_suppkey, sum(l_quantity * cos(l_linenumber * (pi() / 4))) AS x, sum(l_quantity * sin(l_linenumber * (pi() / 4))) AS y, sum(l_quantity) AS s FROM lineitem GROUP BY 1)
SELECT l_suppkey, round((pi() / 4) / (2 * sin(pi() / 8)) * sqrt(x * x + y * y) / s, 6) AS si, round(atan2(y, x), 5) AS preferred FROM a""")
def tuning_vector_sum(s, d):
    return features.vector_sum(t(s, d, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity", 8).select("l_suppkey", r6("si", "si"), r6("preferred", "preferred", 5))


@query(f"""WITH {EPOCH}, b AS (SELECT *, median(CASE WHEN t < 2 THEN v END) OVER (PARTITION BY user_id, rep) AS m FROM sn),
g AS (SELECT user_id, rep, coalesce(avg(CASE WHEN t >= 2 AND t < 4 THEN greatest(v - m, 0) END), 0) AS a, coalesce(avg(CASE WHEN t >= 4 AND t < 6 THEN greatest(v - m, 0) END), 0) AS c FROM b GROUP BY 1, 2)
SELECT user_id, round(avg(CASE WHEN abs(a + c) < 1e-9 THEN 0 ELSE (a - c) / (a + c) END), 6) AS on_off FROM g GROUP BY 1""")
def on_off_index(s, d):
    return features.on_off_index(snips(s, d), "user_id", (2, 4), (4, 6), 2).select("user_id", r6("on_off", "on_off"))


@query(f"""WITH {AVG}, g AS (SELECT user_id, coalesce(avg(CASE WHEN t >= 0 AND t < 3 THEN greatest(average, 0) END), 0) AS a, coalesce(avg(CASE WHEN t >= 3 AND t < 6 THEN greatest(average, 0) END), 0) AS b FROM av GROUP BY 1)
SELECT user_id, round(CASE WHEN abs(a + b) < 1e-9 THEN 0 ELSE (a - b) / (a + b) END, 6) AS polarity FROM g""")
def polarity_index(s, d):
    return features.polarity_index(avgs(s, d), "user_id", (0, 3), (3, 6)).select("user_id", r6("polarity", "polarity"))


@query(f"""WITH {AVG}, c AS (SELECT user_id, t, average - avg(average) {W} AS c FROM av)
SELECT user_id, round(CASE WHEN sum(abs(c)) > 0 THEN sum(CASE WHEN c < 0 THEN -c ELSE 0 END) / sum(abs(c)) ELSE 0 END, 6) AS tonic FROM c WHERE t >= 1 AND t < 9 GROUP BY 1""")
def tonic_release(s, d):
    return features.tonic_release(avgs(s, d), "user_id", 1, 9).select("user_id", r6("tonic", "tonic"))


@query(f"""WITH {AVG}, q AS (SELECT user_id, t, round(average, 9) AS average FROM av), p AS (SELECT *, max(average) {W} AS m, first_value(t) OVER (PARTITION BY user_id ORDER BY average DESC, t) AS p FROM q),
g AS (SELECT user_id, max(m) AS m, avg(CASE WHEN t >= p + 1 AND t < p + 3 THEN average END) AS a FROM p GROUP BY 1)
SELECT user_id, round(CASE WHEN m > 0 AND a IS NOT NULL THEN a / m ELSE -1 END, 6) AS plateau FROM g""")
def plateau_index(s, d):
    a = avgs(s, d).withColumn("average", F.round("average", 9))
    return features.plateau_index(a, "user_id", 1, 2).select("user_id", r6("plateau", "plateau"))


@query(f"""WITH {AVG}, g AS (SELECT user_id, quantile_cont(CASE WHEN t >= 0 AND t < 2 THEN average END, 0.95::DOUBLE) AS a, quantile_cont(CASE WHEN t >= 4 AND t < 6 THEN average END, 0.95::DOUBLE) AS b FROM av GROUP BY 1)
SELECT user_id, round(a, 7) AS first_p95, round(b, 7) AS last_p95, round(CASE WHEN abs(a + b) < 1e-9 THEN 0 ELSE (a - b) / (a + b) END, 6) AS ratio FROM g""")
def freq_response(s, d):
    return features.percentile_contrast(avgs(s, d), "user_id", 6).select("user_id", r6("first_p95", "first_p95", 7), r6("last_p95", "last_p95", 7), r6("ratio", "ratio"))


@query(f"""WITH {AVG}, g AS (SELECT user_id, sum(average * cos(t * (pi() / 2))) AS x, sum(average * sin(t * (pi() / 2))) AS y, count(*) AS n FROM av GROUP BY 1)
SELECT user_id, round(2 * sqrt(x * x + y * y) / n, 4) AS amplitude FROM g""")
def first_harmonic(s, d):
    return features.first_harmonic(avgs(s, d), "user_id", 4).select("user_id", r6("amplitude", "amplitude", 4))


@query(f"WITH {EPOCH} SELECT user_id, round(regr_slope(v, t), 7) AS slope, round(regr_intercept(v, t), 7) AS intercept FROM sn GROUP BY 1 HAVING count(DISTINCT t) > 1")
def linear_baseline_fit(s, d):
    x = snips(s, d)
    many = x.groupBy("user_id").agg(F.countDistinct("t").alias("c")).where("c > 1")
    return features.line_fit(x.join(many, "user_id", "left_semi"), "user_id", "t", "v").select("user_id", r6("slope", "slope", 7), r6("intercept", "intercept", 7))


_DIR = "d AS (SELECT l_suppkey, l_linenumber % 3 AS d, l_partkey % 2 AS rep, l_partkey // 2 % 5 AS t, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_DIR}, m AS (SELECT l_suppkey, d, var_pop(m) AS a FROM (SELECT l_suppkey, d, t, avg(v) AS m FROM d GROUP BY ALL) GROUP BY ALL),
p AS (SELECT l_suppkey, d, avg(x) AS b FROM (SELECT l_suppkey, d, rep, var_pop(v) AS x FROM d GROUP BY ALL) GROUP BY ALL)
SELECT l_suppkey, round(max(CASE WHEN b <> 0 THEN a / b END), 6) AS qi FROM m JOIN p USING (l_suppkey, d) GROUP BY 1""")
def direction_qi(s, d):
    x = t(s, d, "lineitem").groupBy("l_suppkey", (F.col("l_linenumber") % 3).alias("d"), (F.col("l_partkey") % 2).alias("rep"), (F.floor(F.col("l_partkey") / 2) % 5).alias("t")).agg(F.avg("l_quantity").alias("v"))
    return features.direction_qi(x, "l_suppkey").select("l_suppkey", r6("qi", "qi"))


@query()
def permutation_p_value(s, d):
    x = t(s, d, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("dir")).agg(F.avg("l_quantity").alias("r"))
    return features.permutation_p(x, "l_suppkey", "dir", "r", 8, 50)


@query()
def svd_tuning(s, d):
    """Rank-one time x direction components of each supplier's mean responses."""
    from epochal.functions.kernels import rank_one

    def run(pdf):
        m = pdf.pivot_table(index="t", columns="dir", values="r", fill_value=0.0).to_numpy()
        _, dirs, share = rank_one(m)
        return pdf.iloc[:1][["l_suppkey"]].assign(directions=[dirs.tolist()], share=share)

    x = t(s, d, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("dir"), (F.col("l_partkey") % 6).alias("t")).agg(F.avg("l_quantity").alias("r"))
    return x.groupBy("l_suppkey").applyInPandas(run, "l_suppkey long, directions array<double>, share double")


@query("""WITH m AS (SELECT l_suppkey, model, score FROM (SELECT l_suppkey, round(avg(l_tax), 9) AS a, round(avg(l_discount), 9) AS b FROM lineitem GROUP BY 1) UNPIVOT (score FOR model IN (a, b)))
SELECT l_suppkey, model, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score, model) AS r FROM m) WHERE r = 1""")
def glm_best_model(s, d):
    g = t(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_tax"), 9).alias("a"), F.round(F.avg("l_discount"), 9).alias("b"))
    m = g.unpivot(["l_suppkey"], ["a", "b"], "model", "score")
    return algebra.best(m, ["l_suppkey"], "score", "model").select("l_suppkey", "model", r6("score", "score"))


@query("SELECT s_suppkey, round(((s_acctbal > 0)::INTEGER + (s_nationkey > 5)::INTEGER + (s_suppkey % 2 = 0)::INTEGER) / 3.0::DOUBLE, 6) AS fraction FROM supplier")
def quality_fraction(s, d):
    c = lambda e: F.expr(e).cast("int")
    return t(s, d, "supplier").select("s_suppkey", r6((c("s_acctbal > 0") + c("s_nationkey > 5") + c("s_suppkey % 2 = 0")) / 3, "fraction"))


# Masks


def _labels(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 7).alias("a"), (F.col("l_partkey") % 5).alias("b"))


_LAB = "m AS (SELECT l_orderkey, l_linenumber, l_suppkey % 7 AS a, l_partkey % 5 AS b FROM lineitem)"


@query(f"WITH {_LAB} SELECT a, b, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, min(a) AS a, min(b) AS b FROM m GROUP BY 1, 2) GROUP BY ALL")
def label_overlap(s, d):
    on = ["l_orderkey", "l_linenumber"]
    u = _labels(s, d).groupBy(*on).agg(F.min("a").alias("a"), F.min("b").alias("b"))
    return masks.overlap(u.select(*on, "a"), u.select(*on, "b"), on, "a", "b")


@query(f"""WITH {_LAB}, u AS (SELECT l_orderkey, l_linenumber, min(a) AS a, min(b) AS b FROM m GROUP BY 1, 2)
SELECT a, b, round(count(*)::DOUBLE / (any_value(na) + any_value(nb) - count(*)), 6) AS iou FROM (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM u) GROUP BY a, b""")
def label_iou(s, d):
    on = ["l_orderkey", "l_linenumber"]
    u = _labels(s, d).groupBy(*on).agg(F.min("a").alias("a"), F.min("b").alias("b"))
    return masks.iou(u.select(*on, "a"), u.select(*on, "b"), on, "a", "b").select("a", "b", r6("iou", "iou"))


@query("""WITH m AS (SELECT o_orderkey, o_custkey AS label FROM orders) SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY label) < 10 THEN 0 ELSE label END AS label FROM m""")
def remove_small_labels(s, d):
    return masks.remove_small(t(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("label")), "label", 10).select("o_orderkey", "label")


@query("""WITH m AS (SELECT o_orderkey, o_custkey % 11 * 3 AS label FROM orders), r AS (SELECT label, row_number() OVER (ORDER BY label) AS r FROM (SELECT DISTINCT label FROM m WHERE label <> 0))
SELECT o_orderkey, coalesce(r, 0)::INTEGER AS dense FROM m LEFT JOIN r USING (label)""")
def relabel_dense(s, d):
    return masks.relabel_dense(t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 11 * 3).alias("label")), "label").select("o_orderkey", "dense")


_GRID = "g AS (SELECT (l_suppkey % 8)::INTEGER AS x, (l_partkey % 8)::INTEGER AS y, (month(l_shipdate))::INTEGER AS f, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def _grid(s, d):
    return t(s, d, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("int").alias("x"), (F.col("l_partkey") % 8).cast("int").alias("y"), F.month("l_shipdate").alias("f")).agg(F.sum("l_quantity").alias("v"))


#: One image, and two, of all rows.
_ONE = "g AS (SELECT (l_suppkey % 8)::INTEGER AS x, (l_partkey % 8)::INTEGER AS y, 1 AS f, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"
_TWO = "g AS (SELECT (l_suppkey % 8)::INTEGER AS x, (l_partkey % 8)::INTEGER AS y, (l_linenumber % 2 + 1)::INTEGER AS f, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def _one(s, d):
    return t(s, d, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("int").alias("x"), (F.col("l_partkey") % 8).cast("int").alias("y")).agg(F.sum("l_quantity").alias("v"))


def _two(s, d):
    return t(s, d, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("int").alias("x"), (F.col("l_partkey") % 8).cast("int").alias("y"), (F.col("l_linenumber") % 2 + 1).alias("f")).agg(F.sum("l_quantity").alias("v"))


@query(f"""WITH {_GRID}, c AS (SELECT a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, corr(a.v, b.v) AS c FROM g a JOIN g b ON a.f = b.f AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y) GROUP BY ALL)
SELECT x, y, round(avg(CASE WHEN isfinite(c) THEN c END), 6) AS corr FROM c GROUP BY 1, 2""")
def neighbour_corr(s, d):
    return masks.neighbour_correlation(_grid(s, d)).select("x", "y", r6("corr", "corr"))


@query(f"""WITH {_TWO}, a AS (SELECT x, y, v FROM g WHERE f = 1), b AS (SELECT x, y, v FROM g WHERE f = 2), m AS (SELECT dx, dy, round(avg((a.v - b.v) * (a.v - b.v)), 6) AS mse
  FROM (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy), a, b WHERE a.x = b.x + dx AND a.y = b.y + dy GROUP BY 1, 2)
SELECT dx::INTEGER AS dx, dy::INTEGER AS dy, round(mse, 3) AS mse FROM m ORDER BY m.mse, abs(dx), abs(dy), dx, dy LIMIT 1""")
def best_image_shift(s, d):
    g = _two(s, d)
    return masks.best_shift(g.where("f = 1"), g.where("f = 2"), 2).select("dx", "dy", r6("mse", "mse", 3))


@query(f"WITH {_ONE} SELECT ((x + y) % 4)::INTEGER AS label, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS pixels FROM g WHERE f = 1 AND (x + y) % 4 <> 0 GROUP BY 1")
def roi_centres(s, d):
    return masks.centres(_one(s, d).withColumn("label", (F.col("x") + F.col("y")) % 4), "label").select("label", r6("cx", "cx"), r6("cy", "cy"), "pixels")


@query(f"WITH {_ONE}, m AS (SELECT x, y, ((x + y) % 4)::INTEGER AS label FROM g WHERE f = 1) SELECT a.x, a.y, coalesce(b.label, 0) AS label FROM m a LEFT JOIN m b ON b.x + 1 = a.x AND b.y + 2 = a.y")
def shift_image(s, d):
    m = _one(s, d).select("x", "y", ((F.col("x") + F.col("y")) % 4).alias("label"))
    return masks.shifted(m, 1, 2, 8, 8)


@query(f"WITH {_ONE} SELECT x, y, (CASE WHEN (x + y) % 4 = 0 THEN 1 ELSE -((x + y) % 4) END)::INTEGER AS label FROM g WHERE f = 1")
def mask_format(s, d):
    m = _one(s, d).select("x", "y", ((F.col("x") + F.col("y")) % 4).alias("label"))
    return masks.to_negative(masks.to_positive(masks.to_negative(m)))


@query(f"WITH {_ONE} SELECT (x // 2)::BIGINT AS x, (y // 2)::BIGINT AS y, round(avg(v), 4) AS v FROM g WHERE f = 1 GROUP BY 1, 2")
def image_block_mean(s, d):
    return masks.block_mean(_one(s, d), 2).select("x", "y", r6("v", "v", 4))


@query(f"WITH {_ONE}, r AS (SELECT x, y, v FROM g WHERE f = 1) SELECT (x * 2 + a)::INTEGER AS x, (y * 2 + b)::INTEGER AS y, v FROM r, (SELECT unnest(range(2)) AS a), (SELECT unnest(range(2)) AS b)")
def image_pixel_repeat(s, d):
    return masks.pixel_repeat(_one(s, d), 2)


@query(f"""WITH RECURSIVE {_GRID}, m AS (SELECT f, x, y, ((x * 3 + y * 5 + f) % 3)::INTEGER AS label FROM g),
r(f, x, y, label, p) AS (SELECT f, x, y, label, x * 100 + y FROM m WHERE label <> 0 UNION SELECT n.f, n.x, n.y, n.label, r.p FROM r JOIN m n ON n.f = r.f AND n.label = r.label AND abs(n.x - r.x) + abs(n.y - r.y) = 1),
l AS (SELECT f, x, y, min(p) AS p FROM r GROUP BY 1, 2, 3), k AS (SELECT f, x, y, dense_rank() OVER (PARTITION BY f ORDER BY p) AS n FROM l)
SELECT m.f::BIGINT AS f, m.x, m.y, coalesce(n, 0)::INTEGER AS component FROM m LEFT JOIN k USING (f, x, y)""")
def connected_labels(s, d):
    m = _grid(s, d).select(F.col("f").cast("long").alias("f"), "x", "y", ((F.col("x") * 3 + F.col("y") * 5 + F.col("f")) % 3).alias("label"))
    return masks.connected(m, "f", "label")


# Scalars


@query("""WITH c AS (SELECT c_custkey, c_acctbal AS x, c_nationkey * 10.0::DOUBLE AS y, radians(c_custkey % 360) AS r, CASE WHEN c_custkey % 3 = 0 THEN 'left' WHEN c_custkey % 3 = 1 THEN 'right' ELSE 'unknown' END AS eye FROM customer)
SELECT c_custkey, round(-(x * cos(r) + y * sin(r)), 4) AS vd, round(CASE eye WHEN 'right' THEN y * cos(r) - x * sin(r) WHEN 'left' THEN -(y * cos(r) - x * sin(r)) END, 4) AS tn FROM c""")
def retinal_position(s, d):
    k = F.col("c_custkey") % 3
    vd, tn = scalars.retinal_position(F.col("c_acctbal"), F.col("c_nationkey") * 10.0, F.col("c_custkey") % 360, F.when(k == 0, "left").when(k == 1, "right").otherwise("unknown"))
    return t(s, d, "customer").select("c_custkey", r6(vd, "vd", 4), r6(tn, "tn", 4))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'd' ELSE 'v' END || CASE WHEN c_nationkey - 12 >= 0 THEN 'n' ELSE 't' END AS quadrant FROM customer")
def quadrant_category(s, d):
    return t(s, d, "customer").select("c_custkey", scalars.quadrant(F.col("c_acctbal"), F.col("c_nationkey") - 12).alias("quadrant"))


@query("SELECT s_suppkey, (len(list_filter([-1000.0, 0.0, 2500.0, 5000.0], lambda b: b <= s_acctbal)) - 1)::INTEGER AS bin FROM supplier")
def digitize_depth(s, d):
    return t(s, d, "supplier").select("s_suppkey", scalars.digitize(F.col("s_acctbal"), [-1000.0, 0.0, 2500.0, 5000.0]).alias("bin"))


@query("""SELECT s_suppkey, round(CASE WHEN zoom BETWEEN 0.15 AND 4 THEN (CASE setup WHEN 1 THEN 112.0::DOUBLE ELSE 71.5::DOUBLE END) / 64 / zoom END, 6) AS px, CASE setup WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 3 END AS lines
FROM (SELECT s_suppkey, (s_suppkey % 3 + 1)::INTEGER AS setup, (s_suppkey % 10)::DOUBLE / 2 AS zoom FROM supplier)""")
def pixel_size(s, d):
    setup = (F.col("s_suppkey") % 3 + 1).cast("int")
    return t(s, d, "supplier").select("s_suppkey", r6(scalars.pixel_size(setup, F.lit(64), (F.col("s_suppkey") % 10) / 2), "px"), scalars.artifact_lines(setup).alias("lines"))


_FMT = ["%Y%m%d", "%Y-%m-%d", "%Y_%m_%d", "%d.%m.%Y", "%Y.%m.%d", "%d-%m-%Y"]


@query(f"""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 7 {' '.join(f"WHEN {i} THEN strftime(o_orderdate, '{f}')" for i, f in enumerate(_FMT))} ELSE 'no date' END AS s FROM orders)
SELECT o_orderkey, CASE WHEN year(x) BETWEEN 2000 AND 2050 THEN strftime(x, '%Y-%m-%d') END AS day FROM (SELECT o_orderkey, coalesce({', '.join(f"try_strptime(s, '{f}')" for f in _FMT)})::DATE AS x FROM o)""")
def animal_age(s, d):
    k = F.col("o_orderkey") % 7
    text = F.lit("no date")
    for i, f in enumerate(scalars.DATE_FORMATS):
        text = F.when(k == i, F.date_format("o_orderdate", f)).otherwise(text)
    return t(s, d, "orders").select("o_orderkey", F.date_format(scalars.flexible_date(text), "yyyy-MM-dd").alias("day"))


@query("""SELECT p_partkey, md5('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS h FROM part""")
def hash_key(s, d):
    return t(s, d, "part").select("p_partkey", scalars.hash_columns("p_size", "p_brand").alias("h"))


@query("SELECT p_partkey, round(0.1::DOUBLE + 0.9::DOUBLE * pow(p_size, 2) / (pow(p_size, 2) + pow(20, 2)), 6) AS nr, round(2 / (1 + exp(-0.2::DOUBLE * (p_size - 25))), 6) AS sg FROM part")
def saturating_functions(s, d):
    x = F.col("p_size")
    return t(s, d, "part").select("p_partkey", r6(scalars.naka_rushton(x, 0.1, 0.9, 20.0, 2.0), "nr"), r6(scalars.sigmoid(x, 25.0, 0.2, 2.0), "sg"))


@query("SELECT p_partkey, CASE WHEN p_size > 1 AND p_size % 3 > 1 AND p_size % 5 > 1 THEN 'xyz' WHEN p_size > 1 AND p_size % 3 > 1 THEN 'xy' WHEN p_size > 1 AND p_size % 5 > 1 THEN 'xz' END AS scan FROM part")
def scan_type(s, d):
    x = F.col("p_size")
    return t(s, d, "part").select("p_partkey", scalars.scan_type(x, x % 3, x % 5).alias("scan"))


# Sources


@query("SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/')[1] AS host, string_split(regexp_replace(url, '^https?://', ''), '/')[9] AS deep FROM pages")
def filename_tokens(s, d):
    u = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    return t(s, d, "pages").select("page_id", F.get(u, F.lit(0)).alias("host"), F.get(u, F.lit(8)).alias("deep"))


@query("SELECT p_partkey, len(list_intersect(list_filter(string_split(lower(replace(p_type, ' ', '_')), '_'), lambda x: x <> ''), ['promo', 'brass', 'steel'])) > 0 AS hit FROM part")
def alias_match(s, d):
    return t(s, d, "part").select("p_partkey", paths.share_alias(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("PROMO_brass__Steel")).alias("hit"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(s, d):
    return t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""WITH e AS (SELECT user_id, ts, event_type, sum((event_type = 'signup')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT user_id, run::BIGINT AS run, epoch_us(min(CASE WHEN event_type = 'signup' THEN ts END)) / 1e6::DOUBLE AS started, epoch_us(min(CASE WHEN event_type = 'purchase' THEN ts END)) / 1e6::DOUBLE AS ended FROM e WHERE run > 0 GROUP BY 1, 2""")
def log_pairing(s, d):
    e = t(s, d, "events").select("user_id", "event_id", "event_type", MICROS.alias("us"))
    p = logs.pair(e, "user_id", ["us", "event_id"], "us", is_signup(), F.col("event_type") == "purchase")
    return p.select("user_id", "run", (F.col("started") / 1e6).alias("started"), (F.col("ended") / 1e6).alias("ended"))


# Learning


@query("""WITH c AS (SELECT c_custkey, r_name, n_name, c_mktsegment, abs(c_acctbal) / sum(abs(c_acctbal)) OVER () AS p FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_mktsegment, level, class, round(sum(p), 6) AS p FROM (SELECT c_mktsegment, p, r_name, n_name FROM c) UNPIVOT (class FOR level IN (r_name, n_name)) GROUP BY ALL""")
def prob_rollup(s, d):
    c = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    total = t(s, d, "customer").agg(F.sum(F.abs("c_acctbal")).alias("total"))  # one row
    c = c.crossJoin(F.broadcast(total)).withColumn("p", F.abs("c_acctbal") / F.col("total"))
    return learning.roll_up(c, "c_mktsegment", ["r_name", "n_name"], "p").select("c_mktsegment", "level", "class", r6("p", "p"))


_BASIS = [[((i * 7 + j * 3) % 11 - 5) / 10 for i in range(64)] for j in range(3)]


@query("SELECT vec_id, " + ", ".join(f"round(list_dot_product(embedding::DOUBLE[], {b}::DOUBLE[]), 5) AS f{j}" for j, b in enumerate(_BASIS)) + " FROM embeddings")
def feature_dot(s, d):
    p = learning.project_features(t(s, d, "embeddings"), "embedding", _BASIS, ["f0", "f1", "f2"])
    return p.select("vec_id", *[r6(c, c, 5) for c in ("f0", "f1", "f2")])


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), m AS (SELECT label, p, avg(x) AS x FROM x GROUP BY ALL),
c AS (SELECT a.label AS a, b.label AS b, corr(a.x, b.x) AS c FROM m a JOIN m b USING (p) GROUP BY ALL), top AS (SELECT a FROM c GROUP BY 1 ORDER BY round(sum(c), 9) DESC, a LIMIT 1)
SELECT b AS label, row_number() OVER (ORDER BY round(c, 9) DESC, b)::INTEGER AS rank FROM c JOIN top USING (a)""")
def corr_order(s, d):
    x = t(s, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    m = x.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda z: z["x"]).alias("v"))  # one value a dimension
    return learning.order_by_correlation(m, "label", "v")


@query("""WITH n AS (SELECT l_suppkey % 13 AS c, count(*) AS n FROM lineitem WHERE l_quantity > 10 + l_suppkey % 13 * 3 GROUP BY 1)
SELECT c, (CASE WHEN n > 100 THEN row_number() OVER (PARTITION BY n > 100 ORDER BY c) ELSE -1 END)::INTEGER AS pruned, n FROM n""")
def prune_clusters(s, d):
    x = t(s, d, "lineitem").withColumn("c", F.col("l_suppkey") % 13).where("l_quantity > 10 + c * 3").select("c")
    return learning.prune_clusters(x, "c", 100).groupBy("c", "pruned").agg(F.count(F.lit(1)).alias("n"))


@query()
def pca_project(s, d):
    from pyspark.ml.functions import vector_to_array

    out, _ = learning.scaled_pca(t(s, d, "embeddings"), "embedding", 3)
    return out.select("vec_id", vector_to_array("pc").alias("pc"))


@query()
def forest_labels(s, d):
    from pyspark.ml.functions import array_to_vector

    e = t(s, d, "embeddings")
    m = learning.forest(e, "embedding", "label", trees=20)
    return m.transform(e.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))).select("vec_id", "prediction")


# Streaming operators, run over tables


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(s, d):
    return incremental.tumbling(t(s, d, "events")).withColumn("total", F.round("total", 4))


@query("""SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 hour, ts), time_bucket(INTERVAL 12 hour, ts) - INTERVAL 12 hour]) AS w FROM events) GROUP BY 1""")
def sliding_windows(s, d):
    return incremental.sliding(t(s, d, "events"), "24 hours", "12 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hour THEN 0 ELSE 1 END AS b, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, r""")
def session_windows(s, d):
    return incremental.sessions(t(s, d, "events"), "user_id", "6 hours")


# Masks and images: making, comparing, resizing

_LABEL = "((x // 3) * 3 + y // 3)::INTEGER"
_MIX = "((x * 3 + y * 5 + x * y) % 3)::INTEGER"


def _labelled(s, d, mixed: bool = False):
    label = (F.col("x") * 3 + F.col("y") * 5 + F.col("x") * F.col("y")) % 3 if mixed else F.floor(F.col("x") / 3) * 3 + F.floor(F.col("y") / 3)
    return _one(s, d).select("x", "y", label.cast("int").alias("label"))


@query(f"WITH {_ONE} SELECT x, y, ((x - 3.5::DOUBLE) * (x - 3.5::DOUBLE) + (y - 3) * (y - 3)) <= 6.25::DOUBLE AS inside FROM g WHERE f = 1")
def circular_mask(s, d):
    return segmentation.circle(_one(s, d).select("x", "y"), 3.5, 3, 2.5)


@query(f"WITH {_ONE} SELECT x, y, (CASE WHEN x < 2 THEN 0 ELSE {_LABEL} END)::INTEGER AS label FROM g WHERE f = 1")
def artifact_columns(s, d):
    return segmentation.clear_artifact_columns(_labelled(s, d), 2)


@query(f"WITH {_ONE} SELECT y, round(greatest(quantile_cont(v::DOUBLE, 0.7), 100), 6) AS threshold FROM g WHERE f = 1 GROUP BY y")
def line_threshold(s, d):
    return segmentation.line_threshold(_one(s, d), 0.7, 100.0).select("y", r6("threshold", "threshold"))


@query(f"WITH {_ONE}, m AS (SELECT x, y, {_LABEL} AS label FROM g WHERE f = 1) SELECT DISTINCT a.label, b.label AS other FROM m a JOIN m b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE a.label <> 0 AND b.label <> 0 AND a.label <> b.label")
def neighbour_labels(s, d):
    return segmentation.neighbour_labels(_labelled(s, d))


@query(f"WITH {_ONE}, m AS (SELECT x, y, {_MIX} AS label FROM g WHERE f = 1) SELECT x, y, (CASE WHEN EXISTS (SELECT 1 FROM m b WHERE abs(m.x - b.x) + abs(m.y - b.y) = 1 AND b.label = m.label) THEN label ELSE 0 END)::INTEGER AS label FROM m")
def isolated_pixels(s, d):
    return segmentation.remove_isolated(_labelled(s, d, True)).select("x", "y", "label")


@query(f"""WITH {_ONE}, p AS (SELECT x, y, {_LABEL} AS label FROM g WHERE f = 1), q AS (SELECT x, y, {_MIX} AS o FROM g WHERE f = 1),
n AS (SELECT label, o, count(*) AS n FROM p JOIN q USING (x, y) WHERE label <> 0 AND o <> 0 GROUP BY ALL),
i AS (SELECT label, max(n / ((SELECT count(*) FROM p WHERE p.label = n.label) + (SELECT count(*) FROM q WHERE q.o = n.o) - n)) AS iou FROM n GROUP BY label)
SELECT p.label, count(*) AS pixels, round(coalesce(any_value(iou), 0), 6) AS iou FROM p LEFT JOIN i ON i.label = p.label WHERE p.label <> 0 GROUP BY p.label HAVING coalesce(any_value(iou), 0) < 0.2""")
def mask_suggestions(s, d):
    return segmentation.suggestions(_labelled(s, d), _labelled(s, d, True), 0.2).select("label", "pixels", r6("iou", "iou"))


@query(f"""WITH {_ONE}, m AS (SELECT x, y, {_MIX} AS label FROM g), b AS (SELECT a.x, a.y, coalesce(c.label, 0) AS label FROM m a LEFT JOIN m c ON c.x + 1 = a.x AND c.y = a.y),
sh AS (SELECT i.dx, j.dy FROM range(-2, 3) i(dx) CROSS JOIN range(-2, 3) j(dy)), pa AS (SELECT dx, dy, x, y, label AS la FROM m, sh WHERE label <> 0 AND x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7),
pb AS (SELECT dx, dy, x - dx AS x, y - dy AS y, label AS lb FROM b, sh WHERE label <> 0 AND x - dx BETWEEN 0 AND 7 AND y - dy BETWEEN 0 AND 7),
k AS (SELECT dx, dy, count(*) FILTER (WHERE la IS DISTINCT FROM lb) AS bad FROM pa FULL JOIN pb USING (dx, dy, x, y) GROUP BY 1, 2)
SELECT CASE WHEN bad > 0 THEN 'different' WHEN dx = 0 AND dy = 0 THEN 'same' ELSE 'shifted' END AS verdict, dx::INTEGER AS dx, dy::INTEGER AS dy FROM k ORDER BY bad, abs(dx) + abs(dy), dx, dy LIMIT 1""")
def compare_masks(s, d):
    m = _labelled(s, d, True)
    return segmentation.compare(m, masks.shifted(m, 1, 0, 8, 8), 2)


@query(f"WITH {_ONE}, i AS (SELECT x, y, v FROM g WHERE f = 1) SELECT a.a::INTEGER AS x, b.b::INTEGER AS y, round(v::DOUBLE, 4) AS v FROM range(5) a(a) CROSS JOIN range(11) b(b) LEFT JOIN i ON i.x = floor((a.a + 0.5::DOUBLE) * 8 / 5) AND i.y = floor((b.b + 0.5::DOUBLE) * 8 / 11)")
def resize_nearest(s, d):
    return segmentation.resize(_one(s, d), (8, 8), (5, 11)).select("x", "y", r6("v", "v", 4))


@query(f"""WITH {_ONE}, i AS (SELECT x, y, v::DOUBLE AS v FROM g WHERE f = 1), o AS (SELECT a::INTEGER AS x, b::INTEGER AS y, (a + 0.5::DOUBLE) * 0.5::DOUBLE - 0.5::DOUBLE AS sx, (b + 0.5::DOUBLE) * 0.8::DOUBLE - 0.5::DOUBLE AS sy FROM range(16) t(a) CROSS JOIN range(10) u(b)),
c AS (SELECT o.x, o.y, sum(CASE WHEN i.x IS NULL THEN 0 ELSE (1 - abs(i.x - sx)) * (1 - abs(i.y - sy)) * v END) AS v, max(CASE WHEN i.x = floor(sx + 0.5::DOUBLE) AND i.y = floor(sy + 0.5::DOUBLE) THEN 1 END) AS k
FROM o LEFT JOIN i ON abs(i.x - sx) < 1 AND abs(i.y - sy) < 1 GROUP BY ALL)
SELECT x, y, round(CASE WHEN k = 1 THEN greatest((SELECT min(v) FROM i), least((SELECT max(v) FROM i), v)) END, 4) AS v FROM c""")
def resize_linear(s, d):
    return segmentation.resize(_one(s, d), (8, 8), (16, 10), 1).select("x", "y", r6("v", "v", 4))


@query(f"""WITH {_ONE}, i AS (SELECT x, y, v::DOUBLE AS v FROM g), o AS (SELECT a.a AS ox, b.b AS oy, round((a.a - 5) * 0.866025403784::DOUBLE + (b.b - 5) * 0.5::DOUBLE + 3.5::DOUBLE, 9) AS sx,
  round((b.b - 5) * 0.866025403784::DOUBLE - (a.a - 5) * 0.5::DOUBLE + 3.5::DOUBLE, 9) AS sy FROM range(11) a(a) CROSS JOIN range(11) b(b)),
f AS (SELECT *, floor(sx) + p.p AS px, floor(sy) + q.q AS py, (CASE p.p WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE q.q WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS w FROM o CROSS JOIN range(2) p(p) CROSS JOIN range(2) q(q)),
z AS (SELECT min(v) AS low, max(v) AS high FROM i)
SELECT ox::INTEGER AS x, oy::INTEGER AS y, round(CASE WHEN max(CASE WHEN px = floor(sx + 0.5) AND py = floor(sy + 0.5) THEN i.v END) IS NOT NULL THEN greatest(any_value(low), least(any_value(high), sum(w * coalesce(i.v, low)))) END, 4) AS v
FROM f CROSS JOIN z LEFT JOIN i ON i.x = f.px AND i.y = f.py GROUP BY 1, 2""")
def rotate_image(s, d):
    return segmentation.rotate(_one(s, d), (8, 8), 30.0).select("x", "y", r6("v", "v", 4))


@query(f"""WITH {_ONE}, b AS (SELECT {_LABEL} AS label, avg(v) AS b FROM g WHERE f = 1 GROUP BY 1)
SELECT label, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS brightness FROM b WHERE label <> 0""")
def brightness_index(s, d):
    return segmentation.brightness_index(_one(s, d), _labelled(s, d)).select("label", r6("brightness", "brightness"))


@query(f"""WITH {_TWO} SELECT dx::INTEGER AS dx, dy::INTEGER AS dy, round(corr(a.v, b.v), 6) AS corr FROM range(-2, 3) i(dx) CROSS JOIN range(-2, 3) j(dy) JOIN g b ON b.f = 2 JOIN g a ON a.f = 1 AND a.x = b.x + dx AND a.y = b.y + dy GROUP BY ALL""")
def image_cross_correlation(s, d):
    g = _two(s, d)
    return segmentation.cross_correlation(g.where("f = 1"), g.where("f = 2"), 2).select("dx", "dy", r6("corr", "corr"))


@query()
def grow_regions(s, d):
    g = _grid(s, d).groupBy("x", "y").pivot("f", list(range(1, 13))).agg(F.first("v")).fillna(0.0)
    stack = g.select(F.lit(1).cast("long").alias("k"), "x", "y", F.array(*[F.col(str(i)) for i in range(1, 13)]).alias("series"))
    return segmentation.grow(stack, "k", 0.5, 0.0, border=1, least=2)


# Receptive fields: lineitem's months, suppliers and parts are time and space, line numbers are keys

_RF = "r AS (SELECT l_linenumber::BIGINT AS k, month(l_shipdate)::INTEGER AS t, (l_suppkey % 4)::INTEGER AS x, (l_partkey % 4)::INTEGER AS y, round(avg(l_quantity) - 25.5::DOUBLE, 6) AS w FROM lineitem GROUP BY ALL)"


def _rf(s, d):
    k = [F.col("l_linenumber").cast("long").alias("k"), F.month("l_shipdate").alias("t"), (F.col("l_suppkey") % 4).cast("int").alias("x"), (F.col("l_partkey") % 4).cast("int").alias("y")]
    return t(s, d, "lineitem").groupBy(*k).agg(F.round(F.avg("l_quantity") - 25.5, 6).alias("w"))


@query(f"WITH {_RF}, s AS (SELECT k, x, y, stddev_pop(w) AS w FROM r GROUP BY ALL), p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY w DESC, x, y) = 1) SELECT r.k, r.t, r.w, round(p.w, 6) AS space FROM r JOIN p USING (k, x, y)")
def rf_split_sd(s, d):
    srf, trf = receptive.split_sd(_rf(s, d), "k")
    return trf.join(srf.groupBy("k").agg(F.max("w").alias("space")), "k").select("k", "t", "w", r6("space", "space"))


@query(f"WITH {_RF}, p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(w) DESC, t, x, y) = 1) SELECT a.k, b.t, a.x, a.y, CASE WHEN a.w * b.w = 0 THEN 0 ELSE round(a.w * b.w, 6) END AS w FROM (SELECT r.* FROM r JOIN p USING (k, t)) a JOIN (SELECT r.* FROM r JOIN p USING (k, x, y)) b ON a.k = b.k")
def rf_split_peak(s, d):
    w = F.when(F.col("w") == 0, F.lit(0.0)).otherwise(F.round("w", 6))  # no signed zero
    return receptive.merge(*receptive.split_peak(_rf(s, d), "k"), "k").select("k", "t", "x", "y", w.alias("w"))


@query(f"WITH {_RF}, p AS (SELECT k, sign(w) AS s FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(w) DESC, t, x, y) = 1) SELECT k, t, x, y, round(w / sum(greatest(s * w, 0)) OVER (PARTITION BY k), 8) AS w FROM r JOIN p USING (k)")
def rf_normalise(s, d):
    return receptive.normalise(_rf(s, d), "k").select("k", "t", "x", "y", r6("w", "w", 8))


@query(f"WITH {_RF} SELECT k, round(sum(CASE WHEN x IN (1, 2) AND y IN (1, 2) THEN w ELSE 0 END) / sum(abs(w)), 6) AS centre_index, round(sum(CASE WHEN x IN (1, 2) AND y IN (1, 2) THEN 0 ELSE w END) / sum(abs(w)), 6) AS surround_index FROM r GROUP BY k")
def rf_weight_shares(s, d):
    mid = F.col("x").isin(1, 2) & F.col("y").isin(1, 2)
    r = receptive.weight_shares(_rf(s, d).withColumn("c", F.when(mid, F.col("w")).otherwise(0.0)), "k", "c")
    return r.select("k", r6("centre_index", "centre_index"), r6("surround_index", "surround_index"))


@query()
def rf_split_svd(s, d):
    return receptive.split_svd(_rf(s, d), "k")


@query()
def rf_temporal(s, d):
    return receptive.temporal(receptive.split_peak(_rf(s, d), "k")[1], "k", baseline=2.0)


@query()
def rf_spatial_fit(s, d):
    return receptive.spatial(receptive.split_peak(_rf(s, d), "k")[0], "k", 30.0, 30.0)


@query()
def rf_outlines(s, d):
    return receptive.outlines(receptive.split_sd(_rf(s, d), "k")[0], "k", [0.5, 0.7, 0.9])


@query()
def spline_filter(s, d):
    x = samples(s, d).withColumn("stim", is_signup().cast("double"))
    return receptive.spline_filter(x, "user_id", "stim", "v", 6, [3, 5], [0.001, 0.01])


@query()
def contrast_fit(s, d):
    p = t(s, d, "part").groupBy((F.col("p_size") % 5).cast("long").alias("k"), "p_size").agg(F.avg("p_retailprice").alias("r"))
    return receptive.contrast_fit(p, "k", "p_size", "r")


# Labels, stimuli, clustering

_NTH = lambda names, at: f"coalesce(list_extract({[n.replace(chr(39), chr(39) * 2) for n in names]!r}, {at}), 'Unknown')"


@query(
    f"""WITH c AS (SELECT s_suppkey, (s_suppkey * 7 % 80)::INTEGER AS c FROM supplier), n AS (SELECT *, CASE WHEN c = 0 THEN 'Unknown' ELSE {_NTH(cell_types.CLUSTERS, "c")} END AS name FROM c),
g AS (SELECT *, CASE WHEN name = 'Unknown' THEN -1 ELSE regexp_extract(name, '^[0-9]+')::INTEGER END AS grp FROM n)
SELECT s_suppkey, name, grp, CASE WHEN grp < 0 THEN 'Unknown' ELSE {_NTH(cell_types.GROUPS, "grp")} END AS group_name,
CASE WHEN grp < 0 THEN 'Unknown' WHEN grp <= 9 THEN 'OFF' WHEN grp <= 14 THEN 'ON-OFF' WHEN grp <= 20 THEN 'Fast ON' WHEN grp <= 28 THEN 'Slow ON' WHEN grp <= 30 THEN 'Unc. ON' WHEN grp <= 32 THEN 'Unc. SbC' ELSE 'dAC' END AS supergroup,
CASE WHEN name = 'Unknown' THEN -1 ELSE c END AS back FROM g"""
)
def cell_type_labels(s, d):
    c = t(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 80).cast("int").alias("c"))
    g = c.withColumn("name", cell_types.cluster_name(F.col("c"))).withColumn("grp", cell_types.group_id(F.col("c")))
    return g.select("s_suppkey", "name", "grp", cell_types.group_name(F.col("grp")).alias("group_name"), cell_types.supergroup(F.col("grp")).alias("supergroup"), cell_types.cluster_id(F.col("name")).alias("back"))


@query("WITH t AS (SELECT DISTINCT p_brand AS b, unnest(string_split(replace(p_type, ' ', '_'), '_')) AS token FROM part) SELECT token, list_sort(list(b)) AS stimuli FROM t GROUP BY token HAVING count(*) > 1")
def alias_conflicts(s, d):
    return stimuli.conflicts(t(s, d, "part").select(F.col("p_brand").alias("stim_name"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("alias")))


@query()
def sparse_pca(s, d):
    return learning.sparse_pca(t(s, d, "embeddings"), "embedding", 3)[0].select("vec_id", "spc")


@query()
def ward_clusters(s, d):
    return learning.agglomerative(t(s, d, "embeddings"), "embedding", "ward", k=5).select("vec_id", "cluster")


def few_components(s, d):
    return t(s, d, "embeddings").where("embedding is not null").select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("v"))


@query()
def mixture_choice(s, d):
    scores, model = mixtures.choose(few_components(s, d), "v", range(1, 4), cv=3)
    best = min(scores, key=lambda x: x[2])
    return s.createDataFrame([(kind, k, round(v, 3), (kind, k, v) == best) for kind, k, v in scores], "kind string, k int, criterion double, chosen boolean")


@query(
    """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT label, count(*) / (SELECT count(*) FROM e WHERE label BETWEEN 0 AND 9) AS w, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) + 1e-6 AS vx, var_pop(y) + 1e-6 AS vy, var_pop(z) + 1e-6 AS vz FROM e WHERE label BETWEEN 0 AND 9 GROUP BY 1),
p AS (SELECT vec_id, g.label, ln(w) - 0.5 * ((x - mx) ** 2 / vx + (y - my) ** 2 / vy + (z - mz) ** 2 / vz + ln(vx * vy * vz) + 3 * ln(2 * pi())) AS l FROM e, g),
m AS (SELECT vec_id, max(l) AS top FROM p GROUP BY 1)
SELECT p.vec_id, arg_max(p.label, p.l)::INTEGER AS cluster, round(any_value(top) + ln(sum(exp(l - top))), 6) AS log_density FROM p JOIN m ON m.vec_id = p.vec_id GROUP BY 1"""
)
def mixture_density(s, d):
    rows = few_components(s, d)
    model = mixtures.of_labels(rows, "v", {i: i for i in range(10)}, "label", "diag")
    return mixtures.described(rows, "v", model).select("vec_id", "cluster", F.round("log_density", 6).alias("log_density"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from epochal import long_queries as _long  # noqa: E402, F401  (registers further queries)
from epochal import recording_queries as _more  # noqa: E402, F401
