"""Registered queries of recordings, trials, responses, places and clusters, each with the same query in SQL.

Stand-ins as in ``queries``: a user's events are a recording, ``signup`` rows its triggers; file names, headers and
positions are made from keys of suppliers, customers and orders; lineitem rows make images.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import algebra, epochs, learning, places, responses, trials
from epochal.queries import AVG, BASE, EPOCH, _grid, _GRID, avgs, is_signup, query, r6, samples, snips, t
from epochal.sources import logs, recordings

HOUR = 3_600_000_000


def signups(s, d):
    from pyspark.sql import Window

    x = samples(s, d).where(is_signup())
    return x.select("user_id", "us", F.row_number().over(Window.partitionBy("user_id").orderBy("i")).alias("j"))


TRIG = BASE + ", tr AS (SELECT user_id, us, i, n, row_number() OVER (PARTITION BY user_id ORDER BY i) AS j FROM s WHERE event_type = 'signup')"


def _starts_sql(pad: bool) -> str:
    order = "s.us DESC" if pad else f"abs(s.us - tr.us - {HOUR}), s.us"
    only = f"AND s.us <= tr.us + {HOUR}" if pad else ""
    return f"""WITH {TRIG}, c AS (SELECT tr.user_id, tr.j, tr.n, s.i, row_number() OVER (PARTITION BY tr.user_id, tr.j ORDER BY {order}) AS r FROM tr JOIN s ON s.user_id = tr.user_id {only} WHERE (tr.j - 1) % 2 = 0),
b AS (SELECT user_id, j, n, i AS start, lead(i) OVER (PARTITION BY user_id ORDER BY j) - i AS d FROM c WHERE r = 1),
k AS (SELECT *, coalesce(floor(median(d::DOUBLE) OVER (PARTITION BY user_id))::INTEGER + {int(pad)}, n - start + 1) AS k FROM b)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY j) AS rep, start, k FROM k WHERE start + k - 1 <= n"""


# Epochs


@query(_starts_sql(False))
def epoch_starts_delay(s, d):
    return trials.starts(samples(s, d), signups(s, d), "user_id", "us", 2, HOUR, None)


@query(_starts_sql(True))
def epoch_starts_padded(s, d):
    return trials.starts(samples(s, d), signups(s, d), "user_id", "us", 2, HOUR, None, pad=True)


GROUPS = (
    TRIG
    + """, p AS (SELECT *, (j - 1) % 4 AS m FROM tr), q AS (SELECT user_id, j, i AS start, n, CASE WHEN m = 0 THEN 'a' ELSE 'b' END AS name, CASE WHEN m = 3 THEN 1 ELSE 0 END AS part FROM p WHERE m IN (0, 1, 3)),
e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY j), n) AS stop, row_number() OVER (PARTITION BY user_id, name, part ORDER BY j) AS rep FROM q),
gs AS (SELECT user_id, name, rep, part, start, stop FROM e WHERE stop > start)"""
)
_TRIALS = [("a", 1), ("b", 3, 2)]


def group_starts_of(s, d):
    return trials.group_starts(samples(s, d), signups(s, d), "user_id", "us", _TRIALS, 0, None)


@query(f"WITH {GROUPS} SELECT user_id, name, rep, part, start, stop FROM gs")
def group_starts(s, d):
    return group_starts_of(s, d).withColumnRenamed("end", "stop")


@query(f"WITH {GROUPS} SELECT g.user_id, g.name, g.rep, g.part, s.i - g.start AS t, s.v FROM gs g JOIN s ON s.user_id = g.user_id AND s.i >= g.start AND s.i < g.stop")
def group_snippets(s, d):
    return trials.group_snippets(samples(s, d), group_starts_of(s, d), "user_id")


@query(f"""WITH {GROUPS}, l AS (SELECT *, stop - start AS k, max(rep) OVER w AS last FROM gs WINDOW w AS (PARTITION BY user_id, name, part)),
o AS (SELECT *, max(CASE WHEN rep < last THEN k END) OVER (PARTITION BY user_id, name, part) AS other FROM l)
SELECT g.user_id, g.name, g.part, g.rep, count(*) AS n, round(sum(s.v), 4) AS total FROM o g JOIN s ON s.user_id = g.user_id AND s.i >= g.start AND s.i < g.start + CASE WHEN rep = last THEN least(k, coalesce(other, k)) ELSE k END GROUP BY ALL""")
def group_snippets_cut(s, d):
    g = trials.group_snippets(samples(s, d), group_starts_of(s, d), "user_id", "pad")
    return g.groupBy("user_id", "name", "part", "rep").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v"), "total", 4))


_SERIES = f"WITH {GROUPS}, x AS (SELECT g.user_id, g.name, g.part, g.rep, s.i - g.start AS t, s.v FROM gs g JOIN s ON s.user_id = g.user_id AND s.i >= g.start AND s.i < g.stop), n AS (SELECT user_id, name, part, rep, max(t) + 1 AS k FROM x GROUP BY ALL), m AS (SELECT user_id, name, part, min(k) AS least, max(k) AS most FROM n GROUP BY ALL)"


@query(_SERIES + " SELECT user_id, name, part, rep, t, v FROM x UNION ALL SELECT n.user_id, n.name, n.part, n.rep, unnest(range(k, most)) AS t, 0.0 AS v FROM n JOIN m ON n.user_id = m.user_id AND n.name = m.name AND n.part = m.part")
def padded_stack(s, d):
    return trials.padded(trials.group_snippets(samples(s, d), group_starts_of(s, d), "user_id"), ["user_id", "name", "part"], "rep", "t", "v", 0.0)


@query(_SERIES + " SELECT x.user_id, x.name, x.part, x.rep, x.t, x.v FROM x JOIN m ON x.user_id = m.user_id AND x.name = m.name AND x.part = m.part WHERE x.t < m.least")
def truncated_stack(s, d):
    x = trials.truncated(trials.group_snippets(samples(s, d), group_starts_of(s, d), "user_id"), ["user_id", "name", "part"], "rep", "t", 1.0)
    return x.select("user_id", "name", "part", "rep", "t", "v")


@query(f"""WITH {EPOCH}, x AS (SELECT sn.user_id, sn.rep, sn.t, CASE WHEN sn.rep % 3 = 0 OR sn.t > 3 + sn.rep % 2 THEN NULL ELSE sn.v END AS v FROM sn),
l AS (SELECT user_id, rep, max(CASE WHEN v IS NOT NULL THEN t END) AS l FROM x GROUP BY 1, 2 HAVING max(CASE WHEN v IS NOT NULL THEN t END) IS NOT NULL), m AS (SELECT *, min(l) OVER (PARTITION BY user_id) AS m FROM l)
SELECT x.user_id, x.rep, x.t, x.v FROM x JOIN m ON m.user_id = x.user_id AND m.rep = x.rep WHERE x.t <= m.m""")
def repeats_without_empty(s, d):
    gone = (F.col("rep") % 3 == 0) | (F.col("t") > 3 + F.col("rep") % 2)
    return trials.without_empty(snips(s, d).withColumn("v", F.when(~gone, F.col("v"))), "user_id").select("user_id", "rep", "t", "v")


def timed_snips(s, d):
    x = samples(s, d)
    st = epochs.epoch_starts(x, "user_id", is_signup())
    want = st.select("user_id", "rep", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("m"), "start").withColumn("i", F.col("start") + F.col("m"))
    first = x.select("user_id", F.col("i").alias("start"), F.col("us").alias("us0"))
    return want.join(x.select("user_id", "i", "us", "v"), ["user_id", "i"]).join(first, ["user_id", "start"]).select("user_id", "rep", (F.col("us") - F.col("us0")).alias("t"), "v")


_STEP = 12 * HOUR


@query(f"""WITH {EPOCH}, z AS (SELECT st.user_id, st.rep, s.us - f.us AS t, s.v FROM st JOIN s ON s.user_id = st.user_id AND s.i >= st.start AND s.i < st.start + st.k JOIN s f ON f.user_id = st.user_id AND f.i = st.start),
du AS (SELECT user_id, median(d) AS span FROM (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY i) AS d FROM s WHERE event_type = 'signup') WHERE d IS NOT NULL GROUP BY 1),
gr AS (SELECT user_id, unnest(range(0, ceil(span / {_STEP})::BIGINT)) AS g FROM du),
b AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1, row_number() OVER w = 1 AS first FROM z WINDOW w AS (PARTITION BY user_id, rep ORDER BY t)),
y AS (SELECT b.user_id, b.rep, gr.g, CASE WHEN t1 IS NULL THEN v ELSE v + (v1 - v) * ((gr.g * {_STEP} - t)::DOUBLE / (t1 - t)) END AS v FROM b JOIN gr ON gr.user_id = b.user_id AND gr.g * {_STEP} >= b.t AND (b.t1 IS NULL OR gr.g * {_STEP} < b.t1))
SELECT user_id, g, round(avg(v), 7) AS average FROM y GROUP BY 1, 2""")
def resampled_averages(s, d):
    span = trials.median_step(signups(s, d), "user_id", "us")
    return trials.resampled_averages(timed_snips(s, d), "user_id", _STEP, span).select("user_id", "g", r6("average", "average", 7))


@query(f"""WITH {TRIG} SELECT s.user_id, s.event_id, (SELECT max(j) FROM tr WHERE tr.user_id = s.user_id AND tr.us - {HOUR} <= s.us)::INTEGER AS f FROM s
WHERE EXISTS (SELECT 1 FROM tr WHERE tr.user_id = s.user_id AND tr.us - {HOUR} <= s.us)""")
def align_stim_to_trace(s, d):
    frames = signups(s, d).select("user_id", "us", F.col("j").alias("f"))
    return trials.stimulus_to_trace(samples(s, d).select("user_id", "event_id", "us"), frames, "user_id", "us", HOUR).select("user_id", "event_id", "f")


@query(f"""WITH {TRIG}, w AS (SELECT user_id, j, us, CASE WHEN count(*) OVER p > 1 THEN (max(us) OVER p - min(us) OVER p)::DOUBLE / (count(*) OVER p - 1) ELSE 0.0 END AS step FROM tr WINDOW p AS (PARTITION BY user_id))
SELECT user_id, ((j - 1) * 3 + p)::INTEGER AS f, floor(us + step * p / 3)::BIGINT AS us FROM w, (SELECT unnest(range(3)) AS p)""")
def stimulus_frames(s, d):
    return trials.trigger_frames(signups(s, d), "user_id", "us", 3, 1 << 30)


@query(f"WITH {TRIG} SELECT user_id, round(median(d), 3) AS span FROM (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY j) AS d FROM tr) WHERE d IS NOT NULL GROUP BY 1")
def trigger_interval(s, d):
    return trials.median_step(signups(s, d), "user_id", "us").select("user_id", r6("span", "span", 3))


# Responses


@query(f"""WITH {AVG}, b AS (SELECT *, average - avg(CASE WHEN t < 2 THEN average END) OVER (PARTITION BY user_id) AS x FROM av),
p AS (SELECT user_id, t AS p FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY average DESC, t) AS r FROM av WHERE t >= 2 AND t < 6) WHERE r = 1),
g AS (SELECT b.user_id, max(CASE WHEN b.t = p.p THEN x END) AS pk, avg(CASE WHEN b.t >= p.p + 1 AND b.t <= p.p + 3 THEN x END) AS q FROM b LEFT JOIN p ON p.user_id = b.user_id GROUP BY 1)
SELECT user_id, round(CASE WHEN pk > 1e-9 THEN 1 - least(1.0, CASE WHEN q IS NULL THEN 0.0 ELSE greatest(0.0, q) END / pk) ELSE -1 END, 6) AS transience FROM g""")
def transience_index(s, d):
    return responses.transience(avgs(s, d), "user_id", 1.0, 2.0, 1.0).select("user_id", r6("transience", "transience"))


@query(f"""WITH {AVG}, g AS (SELECT user_id, greatest(coalesce(avg(CASE WHEN t >= 2 AND t < 4 THEN average END), 0), 0) AS a, greatest(coalesce(avg(CASE WHEN t >= 5 AND t < 7 THEN average END), 0), 0) AS b FROM av GROUP BY 1)
SELECT user_id, round(a, 5) AS on, round(b, 5) AS off, round(CASE WHEN a + b < 1e-9 THEN 0 ELSE (a - b) / (a + b) END, 5) AS polarity FROM g""".replace(" AS on,", ' AS "on",'))
def step_response(s, d):
    return responses.step_response(avgs(s, d), "user_id", 1.0).select("user_id", r6("on", "on", 5), r6("off", "off", 5), r6("polarity", "polarity", 5))


@query(f"""WITH {AVG}, g AS (SELECT user_id, quantile_cont(CASE WHEN t >= 1 AND t < 3 THEN average END, 0.95) AS l, quantile_cont(CASE WHEN t >= 5 AND t < 7 THEN average END, 0.95) AS h FROM av GROUP BY 1)
SELECT user_id, round(l, 5) AS low, round(h, 5) AS high, round(CASE WHEN abs(l) + abs(h) < 1e-9 THEN -1 ELSE (h - l) / (abs(l) + abs(h)) END, 5) AS "index" FROM g""")
def contrast_response(s, d):
    return responses.level_contrast(avgs(s, d), "user_id", 1.0, 1.0, 7.0).select("user_id", r6("low", "low", 5), r6("high", "high", 5), r6("index", "index", 5))


@query(f"""WITH {BASE}, m AS (SELECT user_id, event_type, i % 3 AS rep, avg(v) AS m FROM s WHERE event_type IN ('click', 'view') GROUP BY ALL), k AS (SELECT user_id, event_type, median(m) AS m FROM m GROUP BY ALL)
SELECT g.user_id, round(g.m - greatest(l.m, 0), 4) AS strength FROM k g JOIN k l ON l.user_id = g.user_id AND l.event_type = 'click' AND g.event_type = 'view'""")
def chirp_surround(s, d):
    x = samples(s, d).withColumn("rep", F.col("i") % 3)
    return responses.surround(x.where("event_type = 'click'"), x.where("event_type = 'view'"), "user_id").select("user_id", r6("strength", "strength", 4))


_SPOT = f"WITH {EPOCH}, m AS (SELECT user_id, ((rep - 1) // 3)::INTEGER AS rep, ((rep - 1) % 3)::INTEGER AS cond, median(v) AS response FROM sn WHERE t < 2 GROUP BY ALL)"


@query(_SPOT + " SELECT user_id, rep, cond, round(response, 4) AS response FROM m")
def spot_matrix(s, d):
    return responses.spot_matrix(snips(s, d), "user_id", 3, 2).select("user_id", "rep", "cond", r6("response", "response", 4))


@query(_SPOT + """, kk AS (SELECT user_id, cond, median(response) AS r FROM m GROUP BY ALL), g AS (SELECT user_id, max(CASE WHEN cond = 0 THEN r END) AS a, max(CASE WHEN cond = 1 THEN r END) AS b, max(CASE WHEN cond = 2 THEN r END) AS c FROM kk GROUP BY 1)
SELECT user_id, round(a, 4) AS response_small, round(b, 4) AS response_large, round(CASE WHEN abs(a) + abs(b) < 1e-9 THEN 0 ELSE (a - b) / (abs(a) + abs(b)) END, 5) AS surround, round(CASE WHEN abs(b) + abs(c) < 1e-9 THEN 0 ELSE (b - c) / (abs(b) + abs(c)) END, 5) AS "offset" FROM g""")
def spot_indices(s, d):
    x = responses.spot_indices(responses.spot_matrix(snips(s, d), "user_id", 3, 2), "user_id", 0, 1, 2)
    return x.select("user_id", r6("response_small", "response_small", 4), r6("response_large", "response_large", 4), r6("surround", "surround", 5), r6("offset", "offset", 5))


_ORDER = [0, 180, 90, 270]
_DIRS = "WITH x AS (SELECT event_type, ((row_number() OVER w - 1) % 8 + 1)::INTEGER AS rep, ((row_number() OVER w - 1) // 8)::INTEGER AS t, value AS v FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), y AS (SELECT event_type, [0, 2, 1, 3][(rep - 1) % 4 + 1]::INTEGER AS d, ((rep - 1) // 4)::INTEGER AS rep, t, v FROM x)"


def bars(s, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    x = t(s, d, "events").select("event_type", (n % 8 + 1).alias("rep"), F.floor(n / 8).cast("int").alias("t"), F.col("value").alias("v"))
    return responses.by_direction(x, "event_type", _ORDER)


@query(_DIRS + " SELECT event_type, d, rep, t, v FROM y")
def direction_rows(s, d):
    return bars(s, d)


@query(_DIRS + " SELECT event_type, d, t, round(avg(v), 5) AS v FROM y GROUP BY ALL")
def direction_averages(s, d):
    return responses.direction_averages(bars(s, d), "event_type").select("event_type", "d", "t", r6("v", "v", 5))


@query()
def direction_tuning(s, d):
    return responses.tuning(bars(s, d), "event_type", _ORDER, 0.128, 2, 200)


_STACK = "k AS (SELECT l_returnflag AS flag, (l_suppkey % 6)::INTEGER AS x, (l_partkey % 5)::INTEGER AS y, month(l_shipdate)::INTEGER AS f, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def stack(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), (F.col("l_suppkey") % 6).cast("int").alias("x"), (F.col("l_partkey") % 5).cast("int").alias("y"), F.month("l_shipdate").alias("f")).agg(F.sum("l_quantity").alias("v"))


@query(f"""WITH {_STACK}, p AS (SELECT flag, x, y, avg(v) AS m FROM k GROUP BY ALL), l AS (SELECT flag, min(m) AS l FROM p WHERE x >= 1 GROUP BY 1), h AS (SELECT flag, quantile_cont(m, 0.99) AS h FROM (SELECT flag, f, median(v) AS m FROM k WHERE x = 0 GROUP BY ALL) GROUP BY 1),
r AS (SELECT flag, (x + y) % 3 AS label, avg(m) AS average FROM p WHERE (x + y) % 3 <> 0 GROUP BY ALL)
SELECT flag, label, round(average, 4) AS average, round((average - l) / (h - l), 5) AS "index" FROM r JOIN l USING (flag) JOIN h USING (flag)""")
def sr_index(s, d):
    k = stack(s, d)
    mask = k.select("flag", "x", "y").distinct().withColumn("label", (F.col("x") + F.col("y")) % 3)
    return responses.brightness_share(k, mask, "flag", 1).select("flag", "label", r6("average", "average", 4), r6("index", "index", 5))


@query(f"WITH {_STACK} SELECT flag, row_number() OVER (PARTITION BY flag ORDER BY f, y) AS i, v FROM k WHERE x = 0")
def light_artifact(s, d):
    return responses.artifact_samples(stack(s, d), "flag").select("flag", "i", "v")


@query(f"WITH {_STACK} SELECT flag, x, y, round(median(v), 4) AS v FROM k GROUP BY ALL")
def stack_medians(s, d):
    return responses.stack_medians(stack(s, d), ["flag"]).select("flag", "x", "y", r6("v", "v", 4))


_PAIR = "k AS (SELECT l_returnflag AS flag, (l_suppkey % 6)::INTEGER AS x, (l_partkey % 5)::INTEGER AS y, (l_linenumber % 2 + 1)::INTEGER AS f, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def pair(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), (F.col("l_suppkey") % 6).cast("int").alias("x"), (F.col("l_partkey") % 5).cast("int").alias("y"), (F.col("l_linenumber") % 2 + 1).alias("f")).agg(F.sum("l_quantity").alias("v"))


_SHIFT = f"""WITH {_PAIR}, a AS (SELECT flag, x, y, v FROM k WHERE f = 1), b AS (SELECT flag, x, y, v FROM k WHERE f = 2),
sc AS (SELECT a.flag, dx::INTEGER AS dx, dy::INTEGER AS dy, -avg((a.v - b.v) * (a.v - b.v)) AS score FROM (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy), a, b WHERE a.flag = b.flag AND a.x = b.x + dx AND a.y = b.y + dy GROUP BY ALL)"""


@query(_SHIFT + " SELECT flag, dx, dy, round(score, 3) AS score FROM sc")
def corr_map_matches(s, d):
    k = pair(s, d)
    return responses.shift_scores(k.where("f = 1"), k.where("f = 2"), "flag", 1).select("flag", "dx", "dy", r6("score", "score", 3))


@query(_SHIFT + " SELECT flag, 2 AS other, -dx AS dx, -dy AS dy, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY score DESC, abs(dx), abs(dy), dx, dy) AS r FROM sc) WHERE r = 1")
def cross_condition_shift(s, d):
    m = pair(s, d).withColumnRenamed("f", "cond")
    return responses.across(m, "cond", 1, ["flag"], 1).select("flag", "other", "dx", "dy", r6("score", "score", 3))


@query(f"WITH {_STACK}, g AS (SELECT DISTINCT flag, x, y FROM k) SELECT DISTINCT flag, CASE flag WHEN 'A' THEN 'shifted' WHEN 'N' THEN 'same' ELSE 'different' END AS relation, CASE flag WHEN 'A' THEN 1 WHEN 'N' THEN 0 END AS dx, CASE flag WHEN 'A' THEN -2 WHEN 'N' THEN 0 END AS dy FROM g")
def mask_relation(s, d):
    m = stack(s, d).select("flag", "x", "y").distinct().withColumn("label", (F.col("x") * 3 + F.col("y")) % 5 + 1)
    a = F.col("flag") == "A"
    moved = m.select("flag", (F.col("x") + F.when(a, 1).otherwise(0)).alias("x"), (F.col("y") - F.when(a, 2).otherwise(0)).alias("y"), F.when(F.col("flag") == "R", F.col("label") % 4 + 1).otherwise(F.col("label")).alias("label"))
    return responses.mask_relation(m, moved, "flag", 2)


_SHIFTS = "sh AS (SELECT user_id, i AS f, (event_id % 7 - 3)::DOUBLE AS dx, (event_id % 5 - 2)::DOUBLE AS dy FROM s)"


@query(f"""WITH {BASE}, {_SHIFTS}, c AS (SELECT user_id, f, dx - median(CASE WHEN f >= 2 AND f < 13 THEN dx END) OVER p AS dx, dy - median(CASE WHEN f >= 2 AND f < 13 THEN dy END) OVER p AS dy FROM sh WINDOW p AS (PARTITION BY user_id))
SELECT *, max(greatest(abs(dx), abs(dy))) OVER (PARTITION BY user_id) AS most FROM c""")
def centred_shifts(s, d):
    x = samples(s, d).select("user_id", F.col("i").alias("f"), (F.col("event_id") % 7 - 3).cast("double").alias("dx"), (F.col("event_id") % 5 - 2).cast("double").alias("dy"))
    return responses.centred_shifts(x, "user_id", 2)


@query(f"WITH {_STACK} SELECT a.flag, a.f, a.x, a.y, coalesce(b.v, 0.0) AS v FROM k a LEFT JOIN k b ON b.flag = a.flag AND b.f = a.f AND b.x + (a.f % 3 - 1) = a.x AND b.y + (a.f % 2) = a.y")
def corrected_stack(s, d):
    k = stack(s, d)
    sh = k.select("flag", "f").distinct().withColumns({"dx": F.col("f") % 3 - 1, "dy": F.col("f") % 2})
    return responses.shifted_frames(k, sh, "flag", 0.0)


@query(f"""WITH {BASE}, x AS (SELECT user_id, i, v, CASE WHEN event_type = 'click' THEN 1.0 ELSE -1.0 END AS b FROM s), d AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY i), 0.0) AS c FROM x),
g AS (SELECT user_id, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(b * v) AS bv, sum(c * v) AS cv FROM d GROUP BY 1)
SELECT user_id, round((cc * bv - bc * cv) / (bb * cc - bc * bc), 3) AS w0, round((bb * cv - bc * bv) / (bb * cc - bc * bc), 3) AS w1 FROM g WHERE bb * cc - bc * bc > 0.5""")
def linear_filter_mle(s, d):
    x = samples(s, d).withColumn("s", F.when(F.col("event_type") == "click", 1).otherwise(0))
    x = x.withColumn("b", responses.binary_stimulus(x))
    rows = responses.design(x, "user_id", "b", 2)
    w = responses.least_squares(rows, "user_id", "v")
    # A filter is told apart where the normal equations have one solution.
    ok = rows.groupBy("user_id").agg((F.sum(F.col("x")[0] * F.col("x")[0]) * F.sum(F.col("x")[1] * F.col("x")[1]) - F.pow(F.sum(F.col("x")[0] * F.col("x")[1]), F.lit(2))).alias("det"))
    return w.join(ok.where("det > 0.5"), "user_id").select("user_id", r6(F.col("w")[0], "w0", 3), r6(F.col("w")[1], "w1", 3))


@query(f"""WITH {BASE}, fr AS (SELECT o_orderkey % 40 AS f, avg(o_totalprice) / 1000 AS a, count(*) / 10.0 AS b FROM orders GROUP BY 1), j AS (SELECT s.user_id, s.v, fr.a, fr.b FROM s JOIN fr ON fr.f = s.i % 40)
SELECT user_id, 0 AS p, round(sum(a * v) / sum(v), 4) AS w FROM j GROUP BY 1 UNION ALL SELECT user_id, 1, round(sum(b * v) / sum(v), 4) FROM j GROUP BY 1""")
def fast_sta(s, d):
    fr = t(s, d, "orders").groupBy((F.col("o_orderkey") % 40).alias("f")).agg((F.avg("o_totalprice") / 1000).alias("a"), (F.count(F.lit(1)) / 10.0).alias("b"))
    frames = fr.select(F.lit(1).alias("pres"), "f", F.array("a", "b").alias("x"))
    x = samples(s, d).select("user_id", F.lit(1).alias("pres"), (F.col("i") % 40).cast("long").alias("f"), "v")
    return responses.shared_design(x, frames, "user_id", ["pres"]).select("user_id", "p", r6("w", "w", 4))


@query(f"""WITH {BASE}, p AS (SELECT user_id, v, 100 + i AS fit, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * 0.8) THEN 'dev' ELSE 'test' END AS part FROM s)
SELECT user_id, part, round(CASE WHEN isfinite(corr(v, fit)) THEN corr(v, fit) END, 5) AS cc, round(avg((v - fit) * (v - fit)), 2) AS mse, count(*) AS n FROM p GROUP BY ALL""")
def sta_data_sets(s, d):
    x = samples(s, d)
    part = F.when(F.col("i") <= F.floor(F.col("n") * 0.6), "train").when(F.col("i") <= F.floor(F.col("n") * 0.8), "dev").otherwise("test")
    g = responses.split_scores(x.withColumns({"fit": 100 + F.col("i"), "part": part}), "user_id", "v", "fit")
    return g.select("user_id", "part", F.when(~F.isnan("cc"), F.round("cc", 5)).alias("cc"), r6("mse", "mse", 2), "n")


@query(f"WITH {BASE}, r AS (SELECT user_id, i, v, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS k FROM s) SELECT user_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS times FROM r WHERE k <= 3 GROUP BY 1")
def last_peaks(s, d):
    p = responses.last_peaks(samples(s, d).select("user_id", F.col("i").alias("t"), "v"), "user_id", 3)
    return p.select("user_id", F.array_join(F.transform("peaks", lambda x: x["t"].cast("string")), ",").alias("times"))


@query(f"WITH {_GRID}, r AS (SELECT f, x, y, row_number() OVER (PARTITION BY f ORDER BY v DESC, x, y) AS rank FROM g) SELECT f, x, y, rank FROM r WHERE rank <= 4")
def top_centres(s, d):
    return responses.top_centres(_grid(s, d), "f", "v", 4).select("f", "x", "y", "rank")


# Recordings

_NAMES = """fl AS (SELECT '/data/' || (k % 4) AS folder, 'SMP_M' || (k % 3) || '_' || ['GCL0', 'GCL1', 'outline'][k % 3 + 1] || '_' || ['chirp', 'mb', 'ods', 'edge3', 'hq', 'noise', 'Chirp'][k % 7 + 1]
  || CASE WHEN k % 5 = 0 THEN '' ELSE '_' || ['C1', 'drug', 'control', 'washout'][k % 4 + 1] END || '_' || k || '.h5' AS filename, k FROM (SELECT c_custkey AS k FROM customer))"""
_READ = f"""WITH {_NAMES}, x AS (SELECT *, string_split(regexp_replace(filename, '\\.[^.]*$', ''), '_') AS w FROM fl),
y AS (SELECT folder, filename, w[2] AS animal, w[3] AS field, w[4] AS stimulus, CASE WHEN len(w) > 5 THEN w[5] ELSE w[5] END AS cond1 FROM x),
z AS (SELECT *, CASE WHEN lower(field) = 'ods' OR lower(stimulus) = 'ods' THEN 'od' WHEN lower(field) IN ('hq', 'hr') OR lower(stimulus) IN ('hq', 'hr') THEN 'hr'
  WHEN regexp_full_match(lower(field), '(outline|edge)[0-9]*') OR regexp_full_match(lower(stimulus), '(outline|edge)[0-9]*') THEN 'outline' ELSE 'response' END AS kind FROM y),
fr AS (SELECT *, folder || '/' || filename AS filepath, round((CASE WHEN kind <> 'response' THEN 3 WHEN lower(stimulus) = 'chirp' THEN 0 WHEN lower(stimulus) = 'mb' THEN 1 ELSE 2 END)
  + CASE WHEN lower(coalesce(cond1, 'none')) IN ('control', 'none', 'c1', 'contr', 'cntr') THEN 0.0 ELSE 0.1 END, 2) AS mask_order FROM z)"""


def file_names(s, d):
    k = F.col("c_custkey")
    pick = lambda items, n: F.array(*map(F.lit, items))[(k % n).cast("int")]
    cond = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("_"), pick(["C1", "drug", "control", "washout"], 4)))
    name = F.concat(F.lit("SMP_M"), k % 3, F.lit("_"), pick(["GCL0", "GCL1", "outline"], 3), F.lit("_"), pick(["chirp", "mb", "ods", "edge3", "hq", "noise", "Chirp"], 7), cond, F.lit("_"), k, F.lit(".h5"))
    return t(s, d, "customer").select(F.concat(F.lit("/data/"), k % 4).alias("folder"), name.alias("filename"))


def files_read(s, d):
    return recordings.file_rows(file_names(s, d), {"animal": 1, "field": 2, "stimulus": 3, "cond1": 4}, "ods", "hq_hr", "outline_edge", "chirp_mb")


@query(_READ + " SELECT folder, filename, animal, field, stimulus, cond1, kind, filepath, mask_order FROM fr")
def file_grammar(s, d):
    return files_read(s, d).withColumn("mask_order", F.round("mask_order", 2))


@query(_READ + " SELECT folder, animal, field, filename FROM (SELECT *, row_number() OVER (PARTITION BY folder, animal, field ORDER BY mask_order, filename) AS r FROM fr) WHERE r = 1")
def first_file(s, d):
    return recordings.preferred(files_read(s, d).withColumn("mask_order", F.round("mask_order", 2)), ["folder", "animal", "field"]).select("folder", "animal", "field", "filename")


@query(_READ + """, p AS (SELECT folder, filename, round((CASE WHEN lower(stimulus) IN ('hq', 'hr') THEN 3 WHEN lower(stimulus) = 'chirp' THEN 0 WHEN lower(stimulus) = 'mb' THEN 1 ELSE 2 END) + (row_number() OVER (PARTITION BY folder ORDER BY filename) - 1) * 0.01
  + CASE WHEN lower(coalesce(cond1, 'none')) IN ('control', 'none', 'c1', 'contr', 'cntr') THEN 0 ELSE 100 END, 2) AS penalty FROM fr)
SELECT folder, filename, penalty, row_number() OVER (PARTITION BY folder ORDER BY penalty, filename) AS rank FROM p""")
def mask_file_order(s, d):
    return recordings.mask_order(files_read(s, d), ["folder"], "stimulus", "cond1", "chirp_mb", "hq_hr").select("folder", "filename", "penalty", "rank")


@query(f"WITH {_NAMES} SELECT folder, filename FROM fl WHERE list_contains(string_split(lower(regexp_replace(filename, '\\.[^.]*$', '')), '_'), 'gcl0')")
def field_files(s, d):
    return recordings.field_files(file_names(s, d), "GCL0")


@query(f"WITH {_NAMES} SELECT DISTINCT folder FROM fl WHERE filename LIKE '%0.h5'")
def folders_with_file(s, d):
    return recordings.folders_with(file_names(s, d), "0.h5")


@query(_READ + """, o AS (SELECT animal, field, lower(stimulus) AS stimulus, min(filename) AS filename FROM fr GROUP BY ALL), st AS (SELECT * FROM (VALUES ('chirp', 'chirp'), ('chirp', 'gchirp'), ('bar', 'mb'), ('bar', 'bar')) v(stim_name, alias)),
j AS (SELECT o.animal, o.field, st.stim_name, min(o.filename) AS filename, count(*) AS n FROM o JOIN st ON lower(o.stimulus) = st.alias GROUP BY ALL) SELECT animal, field, stim_name, filename FROM j""")
def presentation_files(s, d):
    f = files_read(s, d).groupBy("animal", "field", F.lower("stimulus").alias("stimulus")).agg(F.min("filename").alias("filename")).withColumn("filepath", F.col("filename"))
    fields = f.select("animal", "field").distinct()
    stim = s.createDataFrame([("chirp", "chirp_gchirp"), ("bar", "mb_bar")], "stim_name string, alias string")
    return recordings.presentations(fields, f, stim, ["animal", "field"]).select("animal", "field", "stim_name", "filename")


@query("""WITH f AS (SELECT DISTINCT '/d/' || CASE WHEN o_orderkey % 9 = 0 THEN 'notes' ELSE strftime(o_orderdate, '%Y%m%d') END || '/' || (o_orderkey % 3) AS folder FROM orders)
SELECT folder, strftime(try_strptime(string_split(folder, '/')[3], '%Y%m%d')::DATE, '%Y-%m-%d') AS date, string_split(folder, '/')[4]::INTEGER AS exp_num FROM f WHERE string_split(folder, '/')[3] <> 'notes'""")
def experiment_folders(s, d):
    k = F.col("o_orderkey")
    folder = F.concat(F.lit("/d/"), F.when(k % 9 == 0, "notes").otherwise(F.date_format("o_orderdate", "yyyyMMdd")), F.lit("/"), k % 3)
    return recordings.experiments(t(s, d, "orders").select(folder.alias("folder"))).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'wholemount' WHEN 1 THEN 'wholemount' ELSE 'slice' END AS prep, CASE s_suppkey % 2 WHEN 0 THEN 'left' ELSE 'unknown' END AS eye,
(CASE s_suppkey % 5 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 3 THEN 90.5 ELSE -1 END)::DOUBLE AS prepwmorient, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS pharm FROM supplier""")
def header_defaults(s, d):
    k = F.col("s_suppkey")
    put = lambda name, n, items: F.element_at(F.array(*[F.lit(x) for x in items]), (k % n + 1).cast("int"))
    h = F.map_from_arrays(F.array(*map(F.lit, ("prep", "eye", "prepwmorient", "pharmdrug"))), F.array(put("prep", 3, ["", None, "slice"]), put("eye", 2, ["left", None]), put("turn", 5, ["", "unknown", "111", "90.5", None]), put("drug", 3, ["", "None", "GABA"])))
    d0 = t(s, d, "supplier").withColumn("h", h)
    return d0.select("s_suppkey", *[c.alias(n) for n, c in recordings.preparation(F.col("h")).items()])


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 1.5 END::DOUBLE AS odx, CASE WHEN s_suppkey % 3 = 0 THEN -s_suppkey END::DOUBLE AS ody, CASE WHEN s_suppkey % 3 = 0 THEN 7 END::DOUBLE AS odz FROM supplier""")
def disk_header(s, d):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.concat((k * 1.5).cast("string"), F.lit(";-"), k, F.lit("; 7"))).when(k % 3 == 1, "unknown").otherwise("1;2")
    return t(s, d, "supplier").select("s_suppkey", recordings.disk_position(text).alias("p")).select("s_suppkey", "p.*")


_SCAN = """sc AS (SELECT s_suppkey AS k, (s_suppkey % 3 * 32 + 64)::INTEGER AS dx, (CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 32 END)::INTEGER AS dy, (CASE WHEN s_suppkey % 4 IN (0, 1) THEN 16 ELSE 0 END)::INTEGER AS dz, 6 AS retrace, 4 AS offs, 25.0 + s_suppkey % 5 AS dur FROM supplier)"""


def scans(s, d):
    k = F.col("s_suppkey")
    p = F.create_map(F.lit("user_dxpix"), (k % 3 * 32 + 64).cast("double"), F.lit("user_dypix"), F.when(k % 4 == 0, 0.0).otherwise(32.0), F.lit("user_dzpix"), F.when((k % 4).isin(0, 1), 16.0).otherwise(0.0), F.lit("user_npixretrace"), F.lit(6.0), F.lit("user_nxpixlineoffs"), F.lit(4.0), F.lit("realpixdur"), 25.0 + k % 5)
    x = t(s, d, "supplier").select(k.alias("k"), p.alias("p"))
    return x.select("k", *[c.alias(n) for n, c in recordings.scan_columns(F.col("p")).items()])


_SCANNED = f"WITH {_SCAN}, v AS (SELECT k, dx, dx - 10 AS nx, dy, dz, dur * 1e-6 AS px, CASE WHEN dy > 1 AND dz > 1 THEN 'xyz' WHEN dy > 1 THEN 'xy' ELSE 'xz' END AS scan_type FROM sc), u AS (SELECT *, dx * px AS line, dx * px * CASE scan_type WHEN 'xz' THEN dz ELSE dy END AS period FROM v)"


@query(_SCANNED + " SELECT k, scan_type, nx AS pix_nx, round(line, 9) AS line_duration, round(period, 9) AS scan_period, round(1 / period, 5) AS scan_frequency FROM u")
def scan_parameters(s, d):
    return scans(s, d).select("k", "scan_type", "pix_nx", r6("line_duration", "line_duration", 9), r6("scan_period", "scan_period", 9), r6("scan_frequency", "scan_frequency", 5))


@query(_SCANNED + " SELECT k, unnest(range(0, k % 5 + 1))::INTEGER AS frame, round(unnest(range(0, k % 5 + 1)) * period, 8) AS frame_time FROM u")
def frame_times(s, d):
    x = scans(s, d).withColumn("n", (F.col("k") % 5 + 1).cast("int"))
    return recordings.frame_times(x, "n").select("k", "frame", r6("frame_time", "frame_time", 8))


@query(_SCANNED + " SELECT k, round(3 * dx * px, 9) AS by_line, round((3 * dx + 7 + 4) * px, 9) AS by_pixel FROM u")
def pixel_delays(s, d):
    return scans(s, d).select("k", r6(recordings.pixel_delay(F.lit(7), F.lit(3)), "by_line", 9), r6(recordings.pixel_delay(F.lit(7), F.lit(3), "pixel"), "by_pixel", 9))


_CHANNEL = BASE + ", c AS (SELECT user_id, i - 1 AS p, v FROM s)"


def channel(s, d):
    return samples(s, d).select("user_id", (F.col("i") - 1).alias("p"), "v")


@query(f"WITH {_CHANNEL} SELECT user_id, CASE WHEN min(v * 200) < 25000 AND max(v * 200) > 35000 THEN 30000.0 ELSE round((min(v * 200) + max(v * 200)) / 2, 3) END AS threshold FROM c GROUP BY 1")
def trigger_threshold(s, d):
    return recordings.auto_threshold(channel(s, d).withColumn("v", F.col("v") * 200), "user_id").select("user_id", r6("threshold", "threshold", 3))


@query(f"""WITH {_CHANNEL}, h AS (SELECT *, v >= 60 AS h, lag(v >= 60) OVER w AS b, min(CASE WHEN v < 60 THEN p END) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low FROM c WINDOW w AS (PARTITION BY user_id ORDER BY p)),
o AS (SELECT * FROM (SELECT *, p - lag(p) OVER (PARTITION BY user_id ORDER BY p) AS g FROM h WHERE h AND b = false) WHERE g IS NULL OR g >= 3),
f AS (SELECT user_id, min(CASE WHEN v < 60 THEN p END) AS e, bool_or(p = 0 AND v >= 60) AS hi FROM c GROUP BY 1),
x AS (SELECT o.user_id, any_value(f.e) - floor(median(coalesce(low - p - 1, 0)))::BIGINT AS p FROM o JOIN f ON f.user_id = o.user_id WHERE f.hi GROUP BY 1)
SELECT user_id, p, v FROM o UNION ALL SELECT x.user_id, x.p, c.v FROM x LEFT JOIN c ON c.user_id = x.user_id AND c.p = x.p""")
def channel_triggers(s, d):
    return recordings.triggers(channel(s, d), "user_id", 3, 60.0)


@query(f"""WITH {BASE}, x AS (SELECT user_id, i, (i * (user_id % 3) * 300.0 + 100 * (user_id % 4))::DOUBLE AS tt, CASE WHEN user_id % 2 = 0 THEN n * 50.0 END AS e FROM s), y AS (SELECT *, min(tt) OVER p AS a, max(tt) OVER p AS b FROM x WINDOW p AS (PARTITION BY user_id))
SELECT user_id, i, CASE WHEN (e IS NULL AND a > 250 AND b > 1000) OR (e IS NOT NULL AND b > 2 * e) THEN tt / 500 ELSE tt END AS tt FROM y""")
def trigger_units(s, d):
    x = samples(s, d).select("user_id", "i", "n", (F.col("i") * (F.col("user_id") % 3) * 300.0 + 100 * (F.col("user_id") % 4)).alias("tt"))
    end = x.where("user_id % 2 = 0").select("user_id", (F.col("n") * 50.0).alias("end")).distinct()
    return recordings.repair_times(x.select("user_id", "i", "tt"), "user_id", "tt", end)


@query(f"WITH {TRIG} SELECT user_id, count(*) AS n, count(*) % 2 = 0 AS trigger_valid FROM tr GROUP BY 1")
def trigger_counts(s, d):
    return recordings.trigger_check(signups(s, d), "user_id", 2, True)


@query("SELECT o_custkey, min(l) = 0 AS positive, min(l) < 0 AND max(l) IN (0, 1) AS negative FROM (SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 4 ELSE 1 - o_orderkey % 4 END AS l FROM orders) GROUP BY 1")
def mask_formats(s, d):
    k = F.col("o_orderkey") % 4
    return recordings.mask_values(t(s, d, "orders").select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, k).otherwise(1 - k).alias("label")), "o_custkey")


@query("SELECT DISTINCT o_custkey, -(1 - o_orderkey % 4) AS roi FROM orders WHERE 1 - o_orderkey % 4 < 0 AND o_orderkey % 6 >= 2")
def mask_label_list(s, d):
    k = F.col("o_orderkey")
    return recordings.mask_labels(t(s, d, "orders").select("o_custkey", (k % 6).alias("x"), (1 - k % 4).alias("label")), "o_custkey", 2)


@query("""WITH k AS (SELECT s_nationkey, s_name AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS idx FROM supplier WHERE s_suppkey % 3 = 0), m AS (SELECT s_nationkey, max(idx) AS m FROM k GROUP BY 1)
SELECT n.s_nationkey, n.s_name AS path, coalesce(m, 0) + row_number() OVER (PARTITION BY n.s_nationkey ORDER BY s_name) AS idx FROM supplier n LEFT JOIN m ON m.s_nationkey = n.s_nationkey WHERE s_suppkey % 3 <> 0""")
def log_numbers(s, d):
    from pyspark.sql import Window

    x = t(s, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_name").alias("path"))
    known = x.where("s_suppkey % 3 = 0").select("s_nationkey", "path", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("path")).alias("idx"))
    return recordings.log_index(x.select("s_nationkey", "path"), known, "s_nationkey").select("s_nationkey", "path", "idx")


@query(f"""WITH {BASE}, e AS (SELECT user_id, event_id, us, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM s WHERE event_type IN ('signup', 'purchase')),
r AS (SELECT user_id, run, min(CASE WHEN event_type = 'purchase' THEN us END) AS ended FROM e WHERE run > 0 GROUP BY 1, 2)
SELECT p.user_id, p.event_id, arg_max(r.run, r.ended) AS run FROM s p JOIN r ON r.user_id = p.user_id AND r.ended <= p.us WHERE p.event_type = 'view' GROUP BY 1, 2""")
def run_parameters(s, d):
    x = samples(s, d)
    runs = logs.pair(x, "user_id", ["us", "event_id"], "us", F.col("event_type") == "signup", F.col("event_type") == "purchase")
    return logs.attached(runs, x.where("event_type = 'view'").select("user_id", "event_id", "us"), "user_id", "us").select("user_id", "event_id", "run")


# Places


@query("""WITH c AS (SELECT c_nationkey AS k, c_custkey, (c_custkey % 64)::DOUBLE AS cx, (c_custkey % 32)::DOUBLE AS cy FROM customer), b AS (SELECT n_nationkey AS k, n_nationkey * 1.0 AS l, n_nationkey * 0.5 + 3 AS r, n_nationkey % 4 + 2.0 AS th FROM nation)
SELECT c_custkey, round((cy - ((r - l) / 63 * cx + l)) / th, 6) AS depth FROM c JOIN b USING (k)""")
def layer_depth(s, d):
    c = t(s, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", (F.col("c_custkey") % 64).alias("cx"), (F.col("c_custkey") % 32).alias("cy"))
    b = t(s, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 1.0).alias("left"), (F.col("n_nationkey") * 0.5 + 3).alias("right"), (F.col("n_nationkey") % 4 + 2.0).alias("thick"), F.lit(64).alias("w"))
    return places.layer_depth(c, b, "k", "w").select("c_custkey", r6("depth", "depth"))


@query("SELECT c_nationkey, round(coalesce(regr_slope(c_acctbal, c_custkey), 0), 6) AS slope, round(coalesce(regr_intercept(c_acctbal, c_custkey), avg(c_acctbal)), 4) AS intercept FROM customer GROUP BY 1")
def border_lines(s, d):
    p = t(s, d, "customer").select("c_nationkey", F.col("c_custkey").alias("x"), F.col("c_acctbal").alias("y"))
    return places.border_line(p, "c_nationkey").select("c_nationkey", r6("slope", "slope"), r6("intercept", "intercept", 4))


@query("""SELECT s_suppkey, bin_id, (len(list_filter(b, lambda x: x <= s_acctbal)) - 1)::INTEGER AS bin FROM supplier, (SELECT 1 AS bin_id, [-500.0, 0.0, 4000.0] AS b UNION ALL SELECT 2, [1000.0, 2000.0])""")
def depth_bins(s, d):
    sets = s.createDataFrame([(1, [-500.0, 0.0, 4000.0]), (2, [1000.0, 2000.0])], "bin_id int, borders array<double>")
    return places.depth_bins(t(s, d, "supplier"), sets, "s_acctbal").select("s_suppkey", "bin_id", "bin")


_FIELDS = """fd AS (SELECT o_custkey AS k, min(o_orderkey) AS f, min(o_totalprice) / 100 AS absx, avg(o_totalprice) / 100 AS absy, 5.0 AS absz FROM orders GROUP BY 1),
pr AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 30000.0 ELSE o_totalprice / 100 END AS absx, o_totalprice / 100 AS absy, (o_orderkey % 9)::DOUBLE AS absz FROM orders)"""
_REPAIRED = f"""WITH {_FIELDS}, m AS (SELECT k, median(absx) AS mx, median(absy) AS my, median(absz) AS mz, median(CASE WHEN ok THEN absx END) AS ox, median(CASE WHEN ok THEN absy END) AS oy, median(CASE WHEN ok THEN absz END) AS oz, bool_or(ok) AS ok
  FROM (SELECT *, abs(absx) <= 20000 AND abs(absy) <= 20000 AS ok FROM pr) GROUP BY 1), j AS (SELECT fd.*, m.* EXCLUDE (k), abs(mx - absx) > 200 OR abs(my - absy) > 200 AS off FROM fd JOIN m USING (k)),
rp AS (SELECT k, CASE WHEN NOT off THEN absx WHEN ok THEN ox ELSE mx END AS x, CASE WHEN NOT off THEN absy WHEN ok THEN oy ELSE my END AS y, CASE WHEN NOT off THEN absz WHEN ok THEN oz ELSE mz END AS z FROM j)"""


def fields_at(s, d):
    o = t(s, d, "orders")
    f = o.groupBy(F.col("o_custkey").alias("k")).agg((F.min("o_totalprice") / 100).alias("absx"), (F.avg("o_totalprice") / 100).alias("absy"), F.lit(5.0).alias("absz"))
    p = o.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 7 == 0, 30000.0).otherwise(F.col("o_totalprice") / 100).alias("absx"), (F.col("o_totalprice") / 100).alias("absy"), (F.col("o_orderkey") % 9).cast("double").alias("absz"))
    return places.repaired_positions(f, p, ["k"])


@query(_REPAIRED + " SELECT k, round(x, 7) AS absx, round(y, 7) AS absy, round(z, 7) AS absz FROM rp")
def field_positions(s, d):
    return fields_at(s, d).select("k", *[r6(f"abs{a}", f"abs{a}", 7) for a in "xyz"])


@query(_REPAIRED + " SELECT k, round(x - k, 7) AS relx, round(y - 2 * k, 7) AS rely, round(z - 1, 7) AS relz FROM rp WHERE k % 2 = 0")
def field_to_disk(s, d):
    f = fields_at(s, d)
    disks = f.where("k % 2 = 0").select("k", F.col("k").cast("double").alias("odx"), (F.col("k") * 2.0).alias("ody"), F.lit(1.0).alias("odz"))
    return places.relative_to_disk(f, disks, ["k"]).select("k", *[r6(f"rel{a}", f"rel{a}", 7) for a in "xyz"])


@query("""WITH h AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS odx FROM customer), f AS (SELECT o_custkey AS k, arg_min(o_totalprice, struct_pack(r := CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, p := o_orderkey::VARCHAR)) AS odx FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT k, coalesce(f.odx, h.odx) AS odx, CASE WHEN f.k IS NOT NULL THEN 'file' ELSE 'header' END AS source FROM h FULL JOIN f USING (k) WHERE f.odx IS NOT NULL OR h.odx IS NOT NULL""")
def disk_choice(s, d):
    zero = F.lit(0.0)
    h = t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("odx"), zero.alias("ody"), zero.alias("odz"))
    f = t(s, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "h5").otherwise("smp").alias("kind"), F.col("o_orderkey").cast("string").alias("filepath"), F.col("o_totalprice").alias("odx"), zero.alias("ody"), zero.alias("odz"))
    return places.disk_choice(f, h, ["k"]).select("k", "odx", "source")


@query("""WITH c AS (SELECT c_custkey, c_acctbal AS x, (c_nationkey * 10)::DOUBLE AS y, (c_custkey % 4 * 90 - CASE WHEN c_custkey % 4 = 3 THEN 271 ELSE 0 END)::DOUBLE AS o FROM customer), q AS (SELECT *, radians(o) AS r FROM c WHERE o <> -1)
SELECT c_custkey, round(-(x * cos(r) + y * sin(r)), 4) AS vd, round(y * cos(r) - x * sin(r), 4) AS tn FROM q""")
def retinal_fields(s, d):
    k = F.col("c_custkey")
    rows = t(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("relx"), (F.col("c_nationkey") * 10.0).alias("rely"), F.lit("right").alias("eye"), (k % 4 * 90 - F.when(k % 4 == 3, 271).otherwise(0)).alias("prepwmorient"))
    return places.on_retina(rows).select("c_custkey", r6("ventral_dorsal_pos_um", "vd", 4), r6("temporal_nasal_pos_um", "tn", 4))


@query("""WITH q AS (SELECT c_custkey, CASE WHEN c_nationkey - 12 < -4 THEN 't' WHEN c_nationkey - 12 > 4 THEN 'n' ELSE 'c' END AS nt, CASE WHEN c_acctbal < -4 THEN 'v' WHEN c_acctbal > 4 THEN 'd' ELSE 'c' END AS vd FROM customer)
SELECT c_custkey, nt AS nt_side, vd AS vd_side, nt || vd AS ntvd_side, CASE WHEN nt = 't' THEN nt || vd ELSE nt END AS n_tvd_side, CASE WHEN nt = 'n' THEN nt || vd ELSE nt END AS nvd_t_side FROM q""")
def retinal_categories(s, d):
    return t(s, d, "customer").select("c_custkey", *[c.alias(n) for n, c in places.categories(F.col("c_acctbal"), F.col("c_nationkey") - 12, 4.0).items()])


@query("SELECT c_custkey, n_name, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 2 = 0")
def location_lookup(s, d):
    table = t(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return places.looked_up(t(s, d, "customer").select("c_custkey", "c_nationkey"), table, ["c_nationkey"], ["n_name", "n_regionkey"]).select("c_custkey", "n_name", "n_regionkey")


_OFFSET = """rg AS (SELECT p_partkey, radians(p_size % 4 * 90) AS a, (p_partkey % 64 + 0.5 - 32) * 1.5 AS u, (p_size % 32 + 0.5 - 16) * 1.5 AS v FROM part), ro AS (SELECT p_partkey, -(-u * sin(a) + v * cos(a)) AS x, -(u * cos(a) + v * sin(a)) AS y FROM rg)"""


def regions(s, d):
    c = t(s, d, "part").select("p_partkey", (F.col("p_partkey") % 64).alias("cx"), (F.col("p_size") % 32).alias("cy"), F.lit(64).alias("width"), F.lit(32).alias("height"), F.lit(1.5).alias("pixel_um"), F.lit(1.0).alias("z_step_um"), (F.col("p_size") % 4 * 90).alias("angle_deg"), (F.col("p_partkey") % 5).alias("field"))
    return places.region_offset(c)


@query(f"WITH {_OFFSET} SELECT p_partkey, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM ro")
def region_offsets(s, d):
    return regions(s, d).select("p_partkey", (F.round("relx_wrt_field", 4) + 0.0).alias("x"), (F.round("rely_wrt_field", 4) + 0.0).alias("y"))


@query(f"WITH {_OFFSET} SELECT p_partkey, round(x + n_regionkey * 10, 4) AS relx, round(y - n_nationkey, 4) AS rely FROM ro JOIN nation ON n_nationkey = p_partkey % 5")
def region_positions(s, d):
    f = t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("field"), (F.col("n_regionkey") * 10.0).alias("relx"), (F.col("n_nationkey") * -1.0).alias("rely"), F.lit(0.0).alias("relz"))
    return places.region_position(regions(s, d).withColumn("field", F.col("field").cast("long")), f, ["field"]).select("p_partkey", r6("relx", "relx", 4), r6("rely", "rely", 4))


_OUT = "ol AS (SELECT s_nationkey AS k, s_suppkey AS num, s_acctbal AS x, (s_suppkey * 3)::DOUBLE AS y FROM supplier)"


@query(f"WITH {_OUT} SELECT k, string_agg(round(x - 10, 2)::VARCHAR, ',' ORDER BY num) AS xs, string_agg(round(-(x - 10), 2)::VARCHAR, ',' ORDER BY num) AS vd FROM ol GROUP BY 1")
def outlines(s, d):
    p = t(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("num"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 3.0).alias("y"))
    disks = p.select("k").distinct().select("k", F.lit(10.0).alias("odx"), F.lit(0.0).alias("ody"), F.lit(0.0).alias("prepwmorient"), F.lit("right").alias("eye"))
    o = places.relative_outline(places.outline(p, "k"), disks, "k")
    text = lambda c: F.array_join(F.transform(c, lambda v: F.round(v, 2).cast("string")), ",")
    return o.select("k", text(F.col("relative.x")).alias("xs"), text(F.col("retinal.vd")).alias("vd"))


@query("SELECT p_partkey, round((p_size - 9.5) * 30, 3) AS dx_um, round((p_partkey % 15 - 7) * 30, 3) AS dy_um, round(sqrt(pow((p_size - 9.5) * 30, 2) + pow((p_partkey % 15 - 7) * 30, 2)), 3) AS d_um FROM part")
def filter_offsets(s, d):
    f = t(s, d, "part").select("p_partkey", F.col("p_size").alias("x"), (F.col("p_partkey") % 15).alias("y"), F.lit(20).alias("width"), F.lit(15).alias("height"), F.lit(30.0).alias("pixel_um"))
    return places.filter_offset(f).select("p_partkey", r6("dx_um", "dx_um", 3), r6("dy_um", "dy_um", 3), r6("d_um", "d_um", 3))


# Clusters and classes


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN -1 ELSE label END AS c, embedding FROM embeddings), e AS (SELECT c, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM v WHERE c <> -1),
m AS (SELECT c, p, avg(x::DOUBLE) AS m FROM e GROUP BY 1, 2), n AS (SELECT c, count(*) AS n FROM v WHERE c <> -1 GROUP BY 1), top AS (SELECT c FROM n ORDER BY n DESC, c LIMIT 1),
cc AS (SELECT a.c, round(corr(a.m, b.m), 9) AS cc FROM m a JOIN m b ON a.p = b.p AND b.c = (SELECT c FROM top) GROUP BY 1), r AS (SELECT c, row_number() OVER (ORDER BY cc DESC, c DESC) AS r FROM cc), k AS (SELECT c AS s, row_number() OVER (ORDER BY c) AS r FROM n)
SELECT v.vec_id, coalesce(k.s, -1)::INTEGER AS sorted FROM v LEFT JOIN r ON r.c = v.c LEFT JOIN k ON k.r = r.r""")
def sorted_clusters(s, d):
    v = t(s, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("label")).alias("c"), F.col("embedding").cast("array<double>").alias("embedding"))
    return learning.sort_clusters(v, "c", "embedding").select("vec_id", F.col("sorted").cast("int").alias("sorted"))


@query("SELECT vec_id, CASE WHEN (vec_id % 100) / 100.0 >= 0.4 THEN label ELSE -1 END AS cell_class FROM embeddings")
def confidence_gate(s, d):
    v = t(s, d, "embeddings").select("vec_id", F.col("label").alias("cell_class"), ((F.col("vec_id") % 100) / 100.0).alias("confidence"))
    return learning.confident(v, 0.4).select("vec_id", "cell_class")


@query("""SELECT vec_id, round(embedding[1] * 1.0::DOUBLE + embedding[2] * 2.0::DOUBLE, 5) AS f0, round(embedding[1] - embedding[2]::DOUBLE, 5) AS f1, (vec_id % 10) / 10.0::DOUBLE AS p, (vec_id % 50)::DOUBLE AS area, 'chirp_0,bar_0,bar_ds_pvalue,roi_size_um2' AS names FROM embeddings""")
def cell_features(s, d):
    v = t(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("c"), ((F.col("vec_id") % 10) / 10.0).alias("p"), (F.col("vec_id") % 50).cast("double").alias("a"))
    f = learning.cell_features(v, "c", "c", "p", "a", [[1.0, 2.0]], [[1.0, -1.0]])
    return f.select("vec_id", r6(F.col("features")[0], "f0", 5), r6(F.col("features")[1], "f1", 5), F.col("features")[2].alias("p"), F.col("features")[3].alias("area"), F.array_join("feature_names", ",").alias("names"))


@query("""WITH a AS (SELECT c_custkey AS unit, c_mktsegment AS role, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), w AS (SELECT o_custkey AS unit, o_orderstatus AS role, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders GROUP BY 1, 2)
SELECT unit, max(CASE WHEN role = 'O' THEN a END) AS oa, max(CASE WHEN role = 'F' THEN b END) AS fb FROM w WHERE role IN ('O', 'F') GROUP BY 1 HAVING count(DISTINCT role) = 2""")
def role_traces(s, d):
    w = t(s, d, "orders").groupBy(F.col("o_custkey").alias("unit"), F.col("o_orderstatus").alias("role")).agg(F.array(F.min("o_totalprice"), F.max("o_totalprice")).alias("v"))
    m = learning.role_matrix(w, "unit", "role", ["O", "F"], "v")
    return m.select("unit", F.col("O")[0].alias("oa"), F.col("F")[1].alias("fb"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 3) AS mean_o_totalprice, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1, 2")
def results_by_parameter(s, d):
    return algebra.grouped(t(s, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice").withColumn("mean_o_totalprice", F.round("mean_o_totalprice", 3))
