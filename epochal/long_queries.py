"""Registered queries of operators that cut long keys in buckets, and of what follows from them.

Each has the SQL of the same operator uncut, or is held against it in tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import buckets, filters, receptive, responses, tiles
from epochal.queries import BASE, EPOCH, MICROS, SQL, _grid, is_signup, query, r6, samples, t

#: Buckets of a user's month of events: half days.
HALF_DAY = 43_200_000_000


def events(s, d):
    return t(s, d, "events").select("user_id", "event_id", "event_type", "value", MICROS.alias("us"))


def half_days(time="us"):
    return F.floor((F.col(time) if isinstance(time, str) else time) / HALF_DAY)


@query(f"WITH {BASE} SELECT user_id, event_id, i, n, v FROM s")
def long_indexed(s, d):
    return buckets.indexed(events(s, d), "user_id", ["us", "event_id"], "value", half_days()).select("user_id", "event_id", "i", "n", "v")


@query(f"WITH {BASE} SELECT user_id, event_id, round(sum(v) OVER (PARTITION BY user_id ORDER BY i), 6) AS total FROM s")
def long_running_sum(s, d):
    return buckets.running_sum(events(s, d), "user_id", ["us", "event_id"], "value", half_days()).select("user_id", "event_id", r6("total", "total"))


def _asof(how: str):
    def run(s, d):
        e = events(s, d)
        targets = e.where("event_type = 'purchase'").select("user_id", "event_id", "us")
        out = buckets.asof(targets, e.where(is_signup()), "user_id", "us", "value", lambda x: half_days(x), how, 6 * 3_600_000_000)
        return out.select("event_id", F.col("m_time").alias("m_us"), F.col("m_value").alias("m_v"))

    return run


_PAIRS = f"""WITH {BASE}, p AS (SELECT a.event_id, a.us, b.us AS m_us, b.v AS m_v FROM s a LEFT JOIN s b ON b.user_id = a.user_id AND b.event_type = 'signup' AND abs(a.us - b.us) <= 21600000000 {{only}} WHERE a.event_type = 'purchase'),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(us - m_us) NULLS LAST, m_us) AS r FROM p) SELECT event_id, m_us, m_v FROM r WHERE r = 1"""


@query(_PAIRS.format(only="AND b.us <= a.us"))
def long_asof_backward(s, d):
    return _asof("backward")(s, d)


@query(_PAIRS.format(only="AND b.us >= a.us"))
def long_asof_forward(s, d):
    return _asof("forward")(s, d)


@query(_PAIRS.format(only=""))
def long_asof_nearest(s, d):
    return _asof("nearest")(s, d)


@query(f"WITH {EPOCH} SELECT user_id, start, k, rep FROM st")
def long_epoch_starts(s, d):
    return buckets.epoch_starts(samples(s, d), "user_id", is_signup(), 7).select("user_id", F.col("start").cast("long"), "k", F.col("rep").cast("long"))


@query()
def long_lowpass(s, d):
    return buckets.lowpass(samples(s, d), "user_id", 8.0, 1.0, size=64).select("user_id", "i", r6("v", "low"))


# Filters of many columns


@query(
    """SELECT l_returnflag AS flag, round(regr_slope(l_extendedprice, l_quantity), 4) AS w, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
count(*)::DOUBLE AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1"""
)
def products_regression(s, d):
    rows = t(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.array("l_quantity").alias("x"), "l_extendedprice")
    out = filters.solved(filters.products(rows, "flag", "x", "l_extendedprice"), "flag", intercept=True)
    return out.select("flag", r6(F.col("w")[0], "w", 4), r6("intercept", "intercept", 2), "n", r6("r2", "r2"))


@query(
    """WITH e AS (SELECT label, unnest(range(64)) AS a, unnest(embedding)::DOUBLE AS x, embedding[1]::DOUBLE AS y FROM embeddings)
SELECT label, a::INTEGER AS r, round(sum(x * y), 4) AS xy, round(sum(x * x), 4) AS xx, round(sum(x), 4) AS x FROM e GROUP BY 1, 2"""
)
def gram_rows(s, d):
    e = t(s, d, "embeddings").select("label", "embedding", F.col("embedding")[0].alias("y"))
    g = filters.products(e, "label", "embedding", "y").where("r < 64")
    return g.select("label", "r", r6(F.get("s", F.lit(64)), "xy", 4), r6(F.get("s", F.col("r")), "xx", 4), r6(F.get("s", F.lit(65)), "x", 4))


@query()
def filter_many_lags(s, d):
    x = samples(s, d).withColumn("b", F.when(F.col("event_type") == "click", 1.0).otherwise(-1.0)).withColumn("all", F.lit(1))
    return filters.least_squares(responses.design(x, "user_id", "b", 40), "all", "v").select(F.posexplode("w").alias("lag", "w")).select("lag", r6("w", "w", 4))


@query()
def count_model(s, d):
    x = samples(s, d).withColumns({"stim": is_signup().cast("double"), "count": F.floor(F.col("v") / 50)})
    return receptive.response_model(x, "user_id", "stim", "count", 6, [3, 5], [0.001, 0.01])


# Images by tiles


def _labels(s, d):
    return _grid(s, d).select(F.col("f").cast("long").alias("f"), "x", "y", ((F.col("x") * 3 + F.col("y") * 5 + F.col("f")) % 3).alias("label"))


@query(SQL["connected_labels"])
def tiled_components(s, d):
    return tiles.connected(_labels(s, d), "f", "label", tile=2)


@query(
    f"""WITH c AS ({SQL["connected_labels"]}), m AS (SELECT c.*, ((x * 3 + y * 5 + f) % 3)::INTEGER AS label FROM c),
n AS (SELECT f, label, component, count(*) AS n FROM m WHERE component > 0 GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY f, label ORDER BY n DESC, component) AS r FROM n)
SELECT m.f, m.x, m.y, (CASE WHEN b.r = 1 AND b.n >= 2 THEN m.label ELSE 0 END)::INTEGER AS label FROM m LEFT JOIN b ON b.f = m.f AND b.component = m.component"""
)
def largest_label_parts(s, d):
    return tiles.largest_parts(_labels(s, d), "f", "label", tile=3, least=2)
