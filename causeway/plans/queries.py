"""The registered queries of the operators over the driver's tables, and their DuckDB statements."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import arrays as A
from causeway.functions import scalars as S
from causeway.operators import access, hazard, markov, metrics, network, survival
from causeway.operators import panel as panels
from causeway.operators.boosting import BoostedStates
from causeway.operators.lineage import shared_folder
from causeway.plans import optimize, policies
from causeway.plans.experiments import DETERIORATION, matrices
from causeway.plans.registry import ORACLE_SQL, QUERIES, query, r6, rounded
from causeway.register import Register
from causeway.sources import files
from causeway.sources import testdata as T

# --- condition panel -------------------------------------------------------------------

RATINGS = """
rated AS (
    SELECT o_custkey AS key, CAST(year(o_orderdate) AS INTEGER) AS year,
           least(CAST(floor(o_totalprice) AS BIGINT) % 10, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey * 7 % 10 END, o_orderkey % 10) AS r
    FROM orders
), ratings AS (
    SELECT key, year, CAST(CASE WHEN r >= 7 THEN 0 WHEN r >= 5 THEN 1 WHEN r >= 3 THEN 2 ELSE 3 END AS INTEGER) AS state4,
           CAST(CASE WHEN year >= 1950 + key % 50 THEN year - (1950 + key % 50) END AS INTEGER) AS age
    FROM rated
)"""
PANEL = RATINGS + """, panel AS (SELECT key, year, min(state4) AS state4, max(age) AS age FROM ratings GROUP BY key, year)"""
PAIRS = PANEL + """, pairs AS (SELECT a.*, b.state4 AS y_next FROM panel a JOIN panel b ON a.key = b.key AND b.year = a.year + 1)"""
GRID4 = "grid AS (SELECT CAST(a AS INTEGER) AS s, CAST(b AS INTEGER) AS s_next FROM range(4) t(a), range(4) u(b))"
COUNTS4 = f"""{PAIRS}, {GRID4}, counts AS (
    SELECT s, s_next, CAST(count(state4) AS DOUBLE) AS n FROM grid LEFT JOIN pairs ON state4 = s AND y_next = s_next GROUP BY ALL
), m AS (SELECT s, s_next, n, (n + 0.5) / sum(n + 0.5) OVER (PARTITION BY s) AS p FROM counts)"""


@query(f"WITH {PANEL} SELECT key, year, state4, coalesce(age, -1) AS age FROM panel")
def panel_condition_state(spark, d):
    return T.panel(spark, d).select("key", "year", "state4", F.coalesce("age", F.lit(-1)).alias("age"))


@query(f"WITH {PAIRS} SELECT key, year, state4, coalesce(age, -1) AS age, y_next FROM pairs")
def next_year_pairs(spark, d):
    return panels.next_year_pairs(T.panel(spark, d)).select("key", "year", "state4", F.coalesce("age", F.lit(-1)).alias("age"), "y_next")


@query(f"WITH {RATINGS} SELECT a.key, a.year, a.state4, coalesce(a.age, -1) AS age, b.state4 AS y_next FROM ratings a JOIN ratings b ON a.key = b.key AND b.year = a.year + 1")
def next_year_pairs_dups(spark, d):
    return panels.next_year_pairs(T.ratings(spark, d)).select("key", "year", "state4", F.coalesce("age", F.lit(-1)).alias("age"), "y_next")


_STATES = "CASE event_type " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(T.EVENT_TYPES)) + " END"


@query(f"""WITH seq AS (SELECT user_id, ts, event_id, CAST({_STATES} AS INTEGER) AS state FROM events),
nxt AS (SELECT state AS s, lead(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s_next FROM seq)
SELECT CAST(a AS INTEGER) AS s, CAST(b AS INTEGER) AS s_next, CAST(count(nxt.s) AS DOUBLE) AS n
FROM range(5) t(a) CROSS JOIN range(5) u(b) LEFT JOIN nxt ON nxt.s = a AND nxt.s_next = b GROUP BY ALL""")
def transition_counts(spark, d):
    return markov.transition_counts(T.sequences(spark, d), order=["ts", "seq"], states=5)


@query(f"""WITH {PANEL}, nxt AS (
    SELECT CAST(least(floor(age / 10.0), 5) AS INTEGER) AS age_class, state4 AS s, lead(state4) OVER (PARTITION BY key ORDER BY year) AS s_next FROM panel)
SELECT CAST(c AS INTEGER) AS age_class, CAST(a AS INTEGER) AS s, CAST(b AS INTEGER) AS s_next, CAST(count(nxt.s) AS DOUBLE) AS n
FROM range(6) v(c) CROSS JOIN range(4) t(a) CROSS JOIN range(4) u(b)
LEFT JOIN nxt ON nxt.age_class = c AND nxt.s = a AND nxt.s_next = b GROUP BY ALL""")
def transition_counts_by_age(spark, d):
    return markov.transition_counts_by_age(T.panel(spark, d), 6, 10, order="year", state="state4")


def _matrix(spark, d):
    pairs = panels.next_year_pairs(T.panel(spark, d)).select(F.col("state4").alias("s"), F.col("y_next").alias("s_next"))
    return markov.transition_matrix(markov.count_pairs(pairs))


@query(f"WITH {COUNTS4} SELECT s, s_next, n, round(p, 6) AS p FROM m")
def transition_matrix(spark, d):
    return rounded(_matrix(spark, d), "p")


def _row_vectors(spark):
    return spark.range(4).select(F.col("id").cast("int").alias("start"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i == F.col("id")).cast("double")).alias("p0"))


def _walk_sql(steps: int, inside: str) -> str:
    """Distributions after each step as chained tables; ``inside``: which states still walk."""
    parts = ["w0 AS MATERIALIZED (SELECT CAST(x AS INTEGER) AS start, CAST(y AS INTEGER) AS state, CAST(x = y AS DOUBLE) AS p FROM range(4) a(x), range(4) b(y))"]
    parts += [f"w{t} AS MATERIALIZED (SELECT w.start, m.s_next AS state, sum(w.p * m.p) AS p FROM w{t - 1} w JOIN m ON m.s = w.state WHERE {inside} GROUP BY ALL)" for t in range(1, steps + 1)]
    parts.append("walks AS (" + " UNION ALL ".join(f"SELECT {t} AS t, * FROM w{t}" for t in range(steps + 1)) + ")")
    return ", ".join(parts)


@query(f"WITH {COUNTS4}, {_walk_sql(5, 'TRUE')} SELECT start, CAST(t AS INTEGER) AS t, state, round(p, 6) AS p FROM walks")
def markov_forecast(spark, d):
    out = markov.forecasts(_row_vectors(spark), markov.to_numpy(_matrix(spark, d)), 5)
    years = out.select("start", F.posexplode("forecast").alias("t", "v")).select("start", "t", F.posexplode("v").alias("state", "p"))
    return rounded(years, "p")


@query(f"""WITH {COUNTS4}, {_walk_sql(20, 'w.state NOT IN (2, 3)')}
SELECT start, CAST(t AS INTEGER) AS t, round(coalesce(sum(p) FILTER (state IN (2, 3)), 0), 6) AS p FROM walks GROUP BY ALL""")
def first_passage(spark, d):
    m = A.matrix(markov.to_numpy(_matrix(spark, d)))
    out = _row_vectors(spark).select("start", F.posexplode(A.first_passage(F.col("p0"), m, steps=20)).alias("t", "p"))
    return rounded(out, "p")


@query(f"""WITH {COUNTS4}, {_walk_sql(20, 'w.state NOT IN (2, 3)')}
SELECT start, round(coalesce(sum(t * p) FILTER (state IN (2, 3)), 0), 6) AS expected FROM walks GROUP BY ALL""")
def expected_time(spark, d):
    m = A.matrix(markov.to_numpy(_matrix(spark, d)))
    return _row_vectors(spark).select("start", r6(A.expected_time(A.first_passage(F.col("p0"), m, steps=20))).alias("expected"))


@query(f"""WITH {COUNTS4}, {_walk_sql(5, 'TRUE')}, cdf AS (SELECT s, s_next, sum(p) OVER (PARTITION BY s ORDER BY s_next) AS c FROM m),
u AS (SELECT o_orderkey AS k, o_custkey % 4 AS s, o_orderkey AS k0 FROM orders),
l1 AS (SELECT *, (k0 % 2147483648 * 1103515245 + 12345) % 2147483648 AS k1 FROM u), l2 AS (SELECT *, (k1 * 1103515245 + 12345) % 2147483648 AS k2 FROM l1),
l3 AS (SELECT *, (k2 * 1103515245 + 12345) % 2147483648 / 2147483648.0::DOUBLE AS x FROM l2)
SELECT k AS id, CAST(l3.s AS INTEGER) AS state, CAST(least(3, count(*) FILTER (c <= x)) AS INTEGER) AS next_state FROM l3 JOIN cdf ON cdf.s = l3.s GROUP BY k, l3.s""")
def sample_next_state(spark, d):
    cdf = A.matrix(np.cumsum(markov.to_numpy(_matrix(spark, d)), axis=1))
    o = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).cast("int").alias("state"))
    return o.withColumn("next_state", A.next_state(F.get(cdf, F.col("state")), T.uniform(F.col("id"))))


@query()
def dirichlet_matrices(spark, d):
    return rounded(markov.dirichlet_draws(_matrix(spark, d), 20), "p")


_BY_AGE = f"""{PAIRS}, agegrid AS (SELECT CAST(c AS INTEGER) AS age_class, CAST(a AS INTEGER) AS s, CAST(b AS INTEGER) AS s_next FROM range(9) v(c), range(4) t(a), range(4) u(b)),
ac AS (SELECT g.age_class, g.s, g.s_next, count(t.key) AS n FROM agegrid g LEFT JOIN pairs t ON least(floor(coalesce(t.age, 0) / 10.0), 8) = g.age_class AND t.state4 = g.s AND t.y_next = g.s_next GROUP BY ALL),
am AS MATERIALIZED (SELECT *, (n + 0.5) / sum(n + 0.5) OVER (PARTITION BY age_class, s) AS p FROM ac),
latest AS (SELECT key, arg_max(state4, year) AS state4, coalesce(arg_max_null(age, year), 0) AS age FROM panel GROUP BY key),
f0 AS MATERIALIZED (SELECT key, age, CAST(s AS INTEGER) AS state, CAST(s = state4 AS DOUBLE) AS p FROM latest, range(4) t(s)), """ + ", ".join(
    f"f{t} AS MATERIALIZED (SELECT f.key, f.age, m.s_next AS state, sum(f.p * m.p) AS p FROM f{t - 1} f JOIN am m ON m.s = f.state AND m.age_class = least(floor((f.age + {t - 1}) / 10.0), 8) GROUP BY ALL)" for t in range(1, 6)
)


@query(f"WITH {_BY_AGE} " + " UNION ALL ".join(f"SELECT key, CAST({t} AS INTEGER) AS t, state, round(p, 6) AS p FROM f{t}" for t in range(6)))
def markov_forecast_by_age(spark, d):
    pairs = panels.next_year_pairs(T.panel(spark, d))
    rows = matrices(pairs, DETERIORATION, 0.0).collect()
    m = F.array(*(A.matrix([r["p"] for r in sorted(rows, key=lambda r: r["s"]) if r["age_class"] == c]) for c in range(DETERIORATION["n_classes"])))
    latest = T.panel(spark, d).groupBy("key").agg(F.max_by(F.struct("state4", "age"), "year").alias("x"))
    out = latest.select("key", A.forecast_by_age(F.col("x.state4"), F.coalesce("x.age", F.lit(0)), m, 10, 5).alias("f"))
    return out.select("key", F.posexplode("f").alias("t", "v")).select("key", "t", F.posexplode("v").alias("state", "p")).withColumn("p", r6("p"))


_M0 = f"""{PAIRS}, train AS (SELECT * FROM pairs WHERE year <= 1998), test AS (SELECT * FROM pairs WHERE year >= 2000),
agegrid AS (SELECT CAST(c AS INTEGER) AS age_class, CAST(a AS INTEGER) AS s, CAST(b AS INTEGER) AS s_next FROM range(9) v(c), range(4) t(a), range(4) u(b)),
ac AS (SELECT g.age_class, g.s, g.s_next, count(t.key) AS n FROM agegrid g LEFT JOIN train t
       ON least(floor(coalesce(t.age, 0) / 10.0), 8) = g.age_class AND t.state4 = g.s AND t.y_next = g.s_next GROUP BY ALL),
am AS (SELECT *, (n + 0.5) / sum(n + 0.5) OVER (PARTITION BY age_class, s) AS p FROM ac),
clim AS (SELECT y_next AS s_next, count(*) / sum(count(*)) OVER () AS p FROM train GROUP BY y_next),
forecast AS (
    SELECT 'M0 Markov' AS model, t.key, t.year, t.y_next, am.s_next, am.p FROM test t JOIN am ON am.age_class = least(floor(coalesce(t.age, 0) / 10.0), 8) AND am.s = t.state4
    UNION ALL
    SELECT 'climatology', t.key, t.year, t.y_next, g.s_next, coalesce(c.p, 0) FROM test t CROSS JOIN (SELECT CAST(b AS INTEGER) AS s_next FROM range(4) u(b)) g LEFT JOIN clim c USING (s_next)
), cum AS (
    SELECT *, sum(p) OVER (PARTITION BY model, key, year ORDER BY s_next) AS cp, max(p) OVER (PARTITION BY model, key, year) AS top FROM forecast
), scored AS (
    SELECT model, key, year, -ln(least(greatest(sum(p) FILTER (s_next = y_next), 1e-12), 1)) AS ll,
           sum((cp - CASE WHEN y_next <= s_next THEN 1 ELSE 0 END) ** 2) AS rps,
           CASE WHEN min(s_next) FILTER (p = top) = any_value(y_next) THEN 1.0 ELSE 0.0 END AS hit
    FROM cum GROUP BY model, key, year
)"""


@query(f"WITH {_M0} SELECT model, round(avg(ll), 6) AS log_loss, round(avg(rps), 6) AS rps, round(avg(hit), 6) AS accuracy FROM scored GROUP BY model")
def walk_forward_metrics(spark, d):
    train, test = panels.split_by_year(panels.next_year_pairs(T.panel(spark, d)), 1998, 2000)
    rows = matrices(train, DETERIORATION, 0.0)
    m0 = markov.pair_probabilities(test, rows, 10, 9, 0.0).select(F.lit("M0 Markov").alias("model"), "y_next", "p")
    shares = {r[0]: r[1] for r in metrics.climatology(train).collect()}
    flat = test.select(F.lit("climatology").alias("model"), "y_next", A.doubles([shares.get(s, 0.0) for s in range(4)]).alias("p"))
    y, p = F.col("y_next"), F.col("p")
    return m0.unionByName(flat).groupBy("model").agg(r6(metrics.log_loss(y, p)).alias("log_loss"), r6(metrics.ranked_probability_score(y, p)).alias("rps"), r6(metrics.accuracy(y, p)).alias("accuracy"))


@query(f"WITH {PAIRS} SELECT y_next, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM pairs GROUP BY y_next")
def climatology(spark, d):
    return rounded(metrics.climatology(panels.next_year_pairs(T.panel(spark, d))), "p")


@query("""SELECT round(median(c_acctbal), 6) AS c_acctbal, round(median(c_nationkey), 6) AS c_nationkey FROM customer""")
def feature_medians(spark, d):
    c = T.read(spark, d, "customer")
    return rounded(panels.feature_medians(c, ["c_acctbal", "c_nationkey"]), "c_acctbal", "c_nationkey")


@query("""WITH holes AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, CASE WHEN c_nationkey > 3 THEN CAST(c_nationkey AS DOUBLE) END AS nation FROM customer)
SELECT c_custkey, round(coalesce(balance, (SELECT median(balance) FROM holes), 0), 6) AS balance, round(coalesce(nation, (SELECT median(nation) FROM holes), 0), 6) AS nation FROM holes""")
def feature_medians_impute(spark, d):
    c = T.read(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("double")).alias("nation"))
    return rounded(panels.imputed(c, ["balance", "nation"]), "balance", "nation")


def _boosted_sql(rounds: int, rate: float = 0.1) -> str:
    """Two-level trees of all four states, round by round, on ``state4`` and ``age`` as ``BoostedStates`` grows them."""
    at = lambda f: f"CASE {f} WHEN 0 THEN a ELSE b END"
    value = "CASE c.f WHEN 0 THEN c.a ELSE c.b END"

    def level(r: int, n: int, nodes: str) -> str:
        """The best split of each (class, node), from rows ``c, node, a, b, g, w``."""
        return f"""v{r}_{n} AS MATERIALIZED (SELECT k, node, f, v, sum(g) AS g, sum(w) AS w FROM (SELECT k, node, f, {at("f")} AS v, g, w FROM {nodes}, range(2) t(f)) GROUP BY ALL),
        c{r}_{n} AS MATERIALIZED (SELECT *, sum(g) OVER o AS lg, sum(w) OVER o AS lw, sum(g) OVER p AS tg, sum(w) OVER p AS tw FROM v{r}_{n} WINDOW o AS (PARTITION BY k, node, f ORDER BY v), p AS (PARTITION BY k, node, f)),
        b{r}_{n} AS MATERIALIZED (SELECT k, node, f, v FROM (SELECT *, round(lw * (tw - lw) * (lg / lw - (tg - lg) / (tw - lw)) ** 2 / tw ** 2, 12) AS gain FROM c{r}_{n} WHERE lw < tw)
            WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, v) = 1)"""

    parts = ["""obs AS MATERIALIZED (SELECT CAST(state4 AS DOUBLE) AS a, coalesce(age, (SELECT median(age) FROM train)) AS b, y_next AS y, count(*) AS w FROM train GROUP BY ALL)""",
             "shares AS MATERIALIZED (SELECT y AS k, sum(w) / (SELECT sum(w) FROM obs) AS p FROM obs GROUP BY y)",
             """asked AS MATERIALIZED (SELECT DISTINCT a, b FROM obs UNION SELECT DISTINCT CAST(state4 AS DOUBLE), coalesce(age, (SELECT median(age) FROM test)) FROM test)""",
             "s0 AS MATERIALIZED (SELECT a, b, k, ln(p) AS s FROM asked, shares)"]
    for r in range(1, rounds + 1):
        parts += [
            f"p{r} AS MATERIALIZED (SELECT a, b, k, exp(s) / sum(exp(s)) OVER (PARTITION BY a, b) AS p FROM s{r - 1})",
            f"r{r} AS MATERIALIZED (SELECT k, 0 AS node, a, b, sum(CASE WHEN y = k THEN w ELSE 0 END) - sum(w) * any_value(p) AS g, sum(w) * any_value(p) * (1 - any_value(p)) AS h, sum(w) AS w FROM p{r} JOIN obs USING (a, b) GROUP BY k, a, b)",
            level(r, 0, f"r{r}"),
            f"n{r} AS MATERIALIZED (SELECT r.k, CASE WHEN c.f IS NULL OR CASE c.f WHEN 0 THEN r.a ELSE r.b END <= c.v THEN 0 ELSE 1 END AS node, r.a, r.b, g, h, w FROM r{r} r LEFT JOIN b{r}_0 c USING (k))",
            level(r, 1, f"n{r}"),
            f"""q{r} AS MATERIALIZED (SELECT x.a, x.b, x.k, x.node, CASE WHEN d.f IS NULL OR CASE d.f WHEN 0 THEN x.a ELSE x.b END <= d.v THEN 0 ELSE 1 END AS side FROM (
                SELECT s.a, s.b, s.k, CASE WHEN c.f IS NULL OR CASE c.f WHEN 0 THEN s.a ELSE s.b END <= c.v THEN 0 ELSE 1 END AS node FROM s{r - 1} s LEFT JOIN b{r}_0 c USING (k)) x LEFT JOIN b{r}_1 d ON d.k = x.k AND d.node = x.node)""",
            f"l{r} AS MATERIALIZED (SELECT q.k, q.node, q.side, CASE WHEN sum(h) > 1e-150 THEN 0.75 * sum(g) / sum(h) ELSE 0 END AS leaf FROM q{r} q JOIN r{r} r ON r.k = q.k AND r.a = q.a AND r.b = q.b GROUP BY ALL)",
            f"s{r} AS MATERIALIZED (SELECT s.a, s.b, s.k, s.s + {rate} * coalesce(l.leaf, 0) AS s FROM s{r - 1} s JOIN q{r} q USING (a, b, k) LEFT JOIN l{r} l ON l.k = q.k AND l.node = q.node AND l.side = q.side)",
        ]
    return ", ".join(parts)


@query(f"""WITH {PAIRS}, train AS (SELECT * FROM pairs WHERE year <= 1998), test AS (SELECT * FROM pairs WHERE year >= 2000), {_boosted_sql(3)}
SELECT t.key, t.year, x.k AS state, round(exp(x.s) / sum(exp(x.s)) OVER (PARTITION BY t.key, t.year), 6) AS p FROM test t JOIN s3 x ON x.a = t.state4 AND x.b = coalesce(t.age, (SELECT median(age) FROM test))""")
def boosted_rounds(spark, d):
    """Three rounds of two levels, every score by state."""
    train, test = panels.split_by_year(panels.next_year_pairs(T.panel(spark, d)), 1998, 2000)
    columns = ["state4", "age"]
    model = BoostedStates(3, 2).fit(panels.imputed(train, columns), columns, "y_next")
    return rounded(model.predict(panels.imputed(test, columns)).select("key", "year", F.posexplode("p").alias("state", "p")), "p")


@query()
def gbm_next_state(spark, d):
    """A hundred rounds on all features of the sheets."""
    folder = f"{shared_folder(spark)}/gbm-sheets-{uuid.uuid4().hex}"
    T.write_sheets(spark, d, folder, "o_custkey")
    pairs = panels.next_year_pairs(files.load_sheets(spark, folder))
    train, test = panels.split_by_year(pairs, 2096, 2097)
    model = BoostedStates(100, 3).fit(panels.imputed(train, panels.FEATURES), panels.FEATURES, "y_next")
    return model.predict(panels.imputed(test, panels.FEATURES)).select("key", "year", "state", F.transform("p", lambda v: F.round(v, 4)).alias("p"))


# --- survival, conformal, concordance -----------------------------------------------------

_SPELLS = f"""{PANEL}, spells AS (
    SELECT key, CAST(greatest(1, least(5, coalesce(min(year) FILTER (state4 >= 2), max(year)) - min(year) + 1)) AS INTEGER) AS d, CAST(max(state4) >= 2 AS INTEGER) AS e
    FROM panel GROUP BY key)"""


def _spells(spark, d):
    bad = F.min(F.when(F.col("state4") >= 2, F.col("year")))
    return T.panel(spark, d).groupBy("key").agg((F.coalesce(bad, F.max("year")) - F.min("year") + 1).alias("duration"), (F.max("state4") >= 2).cast("int").alias("event"), F.min("age").cast("double").alias("age"))


@query(f"""WITH {_SPELLS}, periods AS (SELECT t, CASE WHEN t = d AND e = 1 THEN 1 ELSE 0 END AS label FROM spells, LATERAL (SELECT unnest(range(1, d + 1)) AS t)),
lt AS (SELECT CAST(t AS INTEGER) AS t, count(*) AS at_risk, CAST(sum(label) AS BIGINT) AS events, sum(label) / count(*) AS hazard FROM periods GROUP BY t),
s AS (SELECT *, CASE WHEN max(CAST(hazard >= 1 AS INTEGER)) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN hazard < 1 THEN ln(1 - hazard) ELSE 0 END) OVER w) END AS survival FROM lt WINDOW w AS (ORDER BY t))
SELECT t, at_risk, events, round(hazard, 6) AS hazard, round(survival, 6) AS survival,
       round(coalesce(lag(survival) OVER (ORDER BY t), 1) * hazard + CASE WHEN t = max(t) OVER () THEN survival ELSE 0 END, 6) AS pmf FROM s""")
def survival_table(spark, d):
    return rounded(survival.life_table(_spells(spark, d), 5), "hazard", "survival", "pmf")


def _newton_sql(steps: int) -> str:
    """Newton steps of the penalised logistic hazard in age and year: normal equations summed, and solved by determinants."""
    parts = ["""obs AS MATERIALIZED (SELECT CAST(x AS DOUBLE) AS x, CAST(t AS DOUBLE) AS t, count(*)::DOUBLE AS n, sum(CASE WHEN t = d AND e = 1 THEN 1.0::DOUBLE ELSE 0 END) AS d
        FROM aged, LATERAL (SELECT unnest(range(1, d + 1)) AS t) WHERE x IS NOT NULL GROUP BY ALL)""", "b0 AS (SELECT 0.0::DOUBLE AS bx, 0.0::DOUBLE AS bt, 0.0::DOUBLE AS b1)"]  # fmt: skip
    for k in range(1, steps + 1):
        parts.append(f"""e{k} AS MATERIALIZED (SELECT any_value(bx) AS bx, any_value(bt) AS bt, any_value(b1) AS b1, 1 + sum(w * x * x) AS a, sum(w * x * t) AS b, sum(w * x) AS c, 1 + sum(w * t * t) AS e, sum(w * t) AS f, sum(w) AS i,
            sum(r * x) - any_value(bx) AS gx, sum(r * t) - any_value(bt) AS gt, sum(r) AS g1
            FROM (SELECT *, d - n * h AS r, n * h * (1 - h) AS w FROM (SELECT *, 1 / (1 + exp(-(bx * x + bt * t + b1))) AS h FROM obs, b{k - 1})))""")
        det = "(a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c))"
        parts.append(f"""b{k} AS MATERIALIZED (SELECT bx + (gx * (e * i - f * f) - b * (gt * i - f * g1) + c * (gt * f - e * g1)) / {det} AS bx,
            bt + (a * (gt * i - f * g1) - gx * (b * i - f * c) + c * (b * g1 - gt * c)) / {det} AS bt, b1 + (a * (e * g1 - gt * f) - b * (b * g1 - gt * c) + gx * (b * f - e * c)) / {det} AS b1 FROM e{k})""")
    return ", ".join(parts)


@query(f"""WITH {_SPELLS}, aged AS (SELECT s.*, (SELECT min(age) FROM panel p WHERE p.key = s.key) AS x FROM spells s), {_newton_sql(10)},
hazards AS (SELECT key, t, 1 / (1 + exp(-(bx * x + bt * t + b1))) AS h FROM aged, b10, range(1, 6) y(t)),
s AS (SELECT key, t, exp(sum(ln(1 - h)) OVER (PARTITION BY key ORDER BY t)) AS s FROM hazards)
SELECT key, CAST(t AS INTEGER) AS t, round(coalesce(s, -1), 6) AS survival, CAST(CASE WHEN count(s) OVER k = 0 THEN 5 ELSE coalesce(min(t) FILTER (s < 0.5) OVER k, 5) END AS DOUBLE) AS median_time FROM s WINDOW k AS (PARTITION BY key)""")
def survival_logistic(spark, d):
    """Survival after each year; -1 where a structure's age isn't known."""
    model = survival.DiscreteTimeSurvival(5).fit(_spells(spark, d), ["age"])
    out = model.predict(_spells(spark, d))
    years = out.select("key", "median_time", F.posexplode("survival").alias("t", "survival")).where("t > 0")
    return years.withColumn("survival", F.coalesce(r6("survival"), F.lit(-1.0)))


_C = "WITH x AS (SELECT s_suppkey % 17 AS t, round(s_acctbal / 100) AS x, s_nationkey % 2 AS e FROM supplier)"


@query(f"""{_C} SELECT round(coalesce(sum(CASE WHEN i.x > j.x THEN 1.0 WHEN i.x < j.x THEN 0.0 ELSE 0.5 END) / count(*), 0.5), 6) AS c_index, count(*) AS n_pairs
FROM x i JOIN x j ON j.t > i.t WHERE i.e <> 0""")
def concordance(spark, d):
    s = T.read(spark, d, "supplier").select((F.col("s_suppkey") % 17).alias("t"), F.round(F.col("s_acctbal") / 100).alias("x"), (F.col("s_nationkey") % 2).alias("e"))
    return rounded(metrics.concordance(s, "t", "x", "e"), "c_index")


_RES = "res AS (SELECT o_orderpriority AS grp, abs(o_totalprice - 150000) AS r FROM orders)"


def _residuals(spark, d):
    return T.read(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") - 150000).alias("residual"))


def _q_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT {by + "," if by else ""} min(r) AS q FROM (SELECT *, row_number() OVER ({part} ORDER BY r) AS i, count(*) OVER ({part}) AS n FROM res)
    WHERE i >= least(ceil((n + 1) * (1.0::DOUBLE - 0.1::DOUBLE)), n) {"GROUP BY " + by if by else ""})"""


@query(f"WITH {_RES} SELECT round(q, 6) AS q FROM {_q_sql('')}")
def conformal_quantile(spark, d):
    return rounded(metrics.conformal_quantiles(_residuals(spark, d), []), "q")


@query(f"WITH {_RES} SELECT grp, round(q, 6) AS q FROM {_q_sql('grp')} UNION ALL SELECT NULL, round(q, 6) FROM {_q_sql('')}")
def conformal_by_group(spark, d):
    return rounded(metrics.conformal_by_group(_residuals(spark, d), "grp"), "q")


@query(f"""WITH {_RES}, g AS {_q_sql('grp')}, p AS {_q_sql('')},
pts AS (SELECT l_linenumber, CASE WHEN l_linenumber > 4 THEN 'other' ELSE o_orderpriority END AS grp, o_totalprice AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT pts.grp, round(avg(CASE WHEN y BETWEEN 150000 - coalesce(g.q, p.q) AND 150000 + coalesce(g.q, p.q) THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM pts LEFT JOIN g USING (grp) CROSS JOIN p GROUP BY pts.grp""")
def conformal_coverage(spark, d):
    o = T.read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    li = T.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    pts = li.select(F.when(F.col("l_linenumber") > 4, "other").otherwise(F.col("o_orderpriority")).alias("grp"), F.col("o_totalprice").alias("y"), F.lit(150000.0).alias("point"))
    out = metrics.with_intervals(pts, metrics.conformal_by_group(_residuals(spark, d), "grp"), "grp")
    return out.groupBy("grp").agg(r6(metrics.coverage(F.col("y"), F.col("lo"), F.col("hi"))).alias("coverage"))


# --- network --------------------------------------------------------------------------------

WAYS = """ways AS (
    SELECT c_nationkey AS u, s_nationkey AS v, l_orderkey * 8 + l_linenumber AS ord, l_extendedprice AS length_m,
           CASE l_returnflag WHEN 'A' THEN 'rural' WHEN 'N' THEN 'state' WHEN 'R' THEN 'national' END AS road_class,
           CAST(CASE l_returnflag WHEN 'A' THEN 30 WHEN 'N' THEN 50 WHEN 'R' THEN 70 END AS DOUBLE) AS speed_kph
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
), timed AS (SELECT least(u, v) AS src, greatest(u, v) AS dst, *, length_m / 1000.0::DOUBLE / speed_kph * 60.0::DOUBLE AS travel_time_min FROM ways),
fastest AS (SELECT src, dst, length_m, road_class, speed_kph, travel_time_min FROM timed QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY travel_time_min, ord) = 1)"""
EDGES = WAYS + """, near AS (
    SELECT * FROM (SELECT src, dst, travel_time_min, unnest([src, dst]) AS node FROM fastest WHERE src <> dst)
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY travel_time_min, src, dst) <= 3
), edges AS (SELECT f.* FROM fastest f WHERE src <> dst AND EXISTS (SELECT 1 FROM near n WHERE n.src = f.src AND n.dst = f.dst)),
arcs AS (SELECT src AS a, dst AS b, travel_time_min AS w FROM edges UNION ALL SELECT dst, src, travel_time_min FROM edges),
homes AS (SELECT c_nationkey AS node, CAST(count(*) AS DOUBLE) AS population FROM customer GROUP BY 1),
places AS (SELECT CASE n_regionkey WHEN 0 THEN 'health' WHEN 1 THEN 'school' END AS facility_type, n_nationkey AS node FROM nation WHERE n_regionkey IN (0, 1)),
services AS (SELECT * FROM (VALUES ('health', 60.0::DOUBLE, 1.0::DOUBLE), ('school', 45.0::DOUBLE, 0.5::DOUBLE)) t(facility_type, cap_min, weight))"""


@query(f"WITH {WAYS} SELECT src, dst, round(length_m, 6) AS length_m, road_class, round(travel_time_min, 6) AS travel_time_min FROM fastest")
def edge_collapse_fastest(spark, d):
    return rounded(network.fastest_edges(T.ways(spark, d)).select("src", "dst", "length_m", "road_class", "travel_time_min"), "length_m", "travel_time_min")


@query(f"""WITH {WAYS} SELECT count(*) AS n_edges, count(*) FILTER (road_class = 'rural') AS n_bridges, count(*) FILTER (speed_kph > 60) AS n_culverts,
round(avg(CASE WHEN road_class = 'rural' THEN 1.0 ELSE 0 END), 6) AS bridge_share, round(avg(CASE WHEN speed_kph > 60 THEN 1.0 ELSE 0 END), 6) AS culvert_share FROM fastest""")
def tag_coverage(spark, d):
    e = network.fastest_edges(T.ways(spark, d)).withColumns({"is_bridge": F.col("road_class") == "rural", "is_culvert": F.col("speed_kph") > 60})
    return rounded(network.tag_coverage(e), "bridge_share", "culvert_share")


@query(f"""WITH {EDGES}, cuts AS (SELECT src, dst, 0.25::DOUBLE AS f, 1000 + src * 25 + dst AS node FROM edges WHERE road_class = 'national'
    UNION ALL SELECT src, dst, 0.75::DOUBLE, 2000 + src * 25 + dst FROM edges WHERE road_class = 'national'),
stops AS (SELECT src, dst, f, node FROM cuts UNION ALL SELECT DISTINCT src, dst, 0, src FROM cuts UNION ALL SELECT DISTINCT src, dst, 1, dst FROM cuts),
pieces AS (SELECT src, dst, node AS a, lead(node) OVER w AS b, lead(f) OVER w - f AS share FROM stops WINDOW w AS (PARTITION BY src, dst ORDER BY f))
SELECT least(a, b) AS src, greatest(a, b) AS dst, round(length_m * share, 6) AS length_m, round(travel_time_min * share, 6) AS travel_time_min
FROM pieces JOIN edges USING (src, dst) WHERE b IS NOT NULL
UNION ALL SELECT src, dst, round(length_m, 6), round(travel_time_min, 6) FROM edges WHERE road_class <> 'national'""")
def split_edges(spark, d):
    edges = T.edges(spark, d)
    nodes = T.read(spark, d, "nation").select(F.col("n_nationkey").alias("node_id"), F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"), F.lit("junction").alias("kind"))
    put = edges.where("road_class = 'national'").select(F.col("src").alias("u"), F.col("dst").alias("v"), F.explode(F.array(F.struct(F.lit(0.25).alias("f"), F.lit(1000).alias("base")), F.struct(F.lit(0.75).alias("f"), F.lit(2000).alias("base")))).alias("e"))
    put = put.select("u", "v", F.col("e.f").alias("fraction"), (F.col("e.base") + F.col("u") * 25 + F.col("v")).alias("node_id"), F.lit("culvert").alias("structure_type"))
    _, out = network.split_edges(nodes, edges, put)
    return rounded(out.select("src", "dst", "length_m", "travel_time_min"), "length_m", "travel_time_min")


_POINTS = "points AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, label FROM embeddings)"


@query(f"""WITH {_POINTS}, best AS (SELECT p.id, arg_min(t.id, (sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2), t.id)) AS target, min(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)) AS dist
    FROM points p CROSS JOIN points t WHERE p.label <> 0 AND t.label = 0 GROUP BY p.id)
SELECT id, dist <= 25 AS is_attached, CASE WHEN dist <= 25 THEN target ELSE -1 END AS attached_to, round(dist, 6) AS dist, round(CASE WHEN dist <= 25 THEN dist / 1000 / 5 * 60 END, 6) AS travel_time_min FROM best""")
def snap_nearest(spark, d):
    p = T.points(spark, d)
    nodes = p.where("label = 0").select(F.col("id").alias("node_id"), "x", "y")
    out = network.snap(p.where("label <> 0").select("id", "x", "y", F.lit("habitation").alias("kind")), nodes)
    return rounded(out.select("id", "is_attached", F.coalesce("attached_to", F.lit(-1)).alias("attached_to"), "dist", "travel_time_min"), "dist", "travel_time_min")


@query(f"""WITH {_POINTS}, best AS (SELECT p.id, arg_min(t.id, (sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2), t.id)) AS target FROM points p CROSS JOIN points t WHERE p.label <> 0 AND t.label = 0 GROUP BY p.id)
SELECT t.id AS node_id, CAST(coalesce(sum(b.id % 100), 0) AS DOUBLE) AS population FROM points t LEFT JOIN best b ON b.target = t.id WHERE t.label = 0 GROUP BY t.id""")
def population_alloc(spark, d):
    p = T.points(spark, d)
    cells = p.where("label <> 0").select("id", "x", "y", (F.col("id") % 100).cast("double").alias("population"))
    return network.allocate_population(cells, p.where("label = 0").select(F.col("id").alias("node_id"), "x", "y"))


def _segment_sql(a: str, b: str) -> str:
    cross = lambda p, q, r: f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
    d1, d2 = cross(f"{b}.p", f"{b}.q", f"{a}.p"), cross(f"{b}.p", f"{b}.q", f"{a}.q")
    d3, d4 = cross(f"{a}.p", f"{a}.q", f"{b}.p"), cross(f"{a}.p", f"{a}.q", f"{b}.q")
    return f"sign({d1}) * sign({d2}) < 0 AND sign({d3}) * sign({d4}) < 0"


@query(f"""WITH lines AS (SELECT vec_id AS edge_id, label, CAST(embedding[3] AS DOUBLE) * 1000 AS px, CAST(embedding[4] AS DOUBLE) * 1000 AS py, CAST(embedding[5] AS DOUBLE) * 1000 AS qx, CAST(embedding[6] AS DOUBLE) * 1000 AS qy FROM embeddings)
SELECT DISTINCT r.edge_id FROM lines r JOIN lines w ON r.label <> 0 AND w.label = 0 AND {_segment_sql('r', 'w')}""")
def bbox_crossings(spark, d):
    lines = T.polylines(spark, d, 2)
    return network.crossings(lines.where("label <> 0").select(F.col("vec_id").alias("edge_id"), "points"), lines.where("label = 0").select(F.col("vec_id").alias("water_id"), "points"), cell=100.0)


def _chain(rounds: int, first: str, step: str) -> str:
    parts = [f"d0 AS MATERIALIZED ({first})", *(f"d{t} AS MATERIALIZED ({step.format(prev=f'd{t - 1}')})" for t in range(1, rounds + 1))]
    return ", ".join(parts)


_LABELS = _chain(10, "SELECT n_nationkey AS node, n_nationkey AS c FROM nation WHERE n_regionkey <> 2",
                 "SELECT node, min(c) AS c FROM (SELECT node, c FROM {prev} UNION ALL SELECT k.b, p.c FROM kept k JOIN {prev} p ON p.node = k.a) GROUP BY node")
_KEPT = EDGES + """, kept AS (SELECT a, b FROM arcs JOIN nation na ON na.n_nationkey = a JOIN nation nb ON nb.n_nationkey = b WHERE na.n_regionkey <> 2 AND nb.n_regionkey <> 2 AND na.n_regionkey = nb.n_regionkey)"""


def _regional(spark, d):
    """Nations outside region 2 and the roads inside a region."""
    n = T.read(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("node_id"), "n_regionkey")
    e = T.edges(spark, d).join(n.select(F.col("node_id").alias("src"), F.col("n_regionkey").alias("a")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("n_regionkey").alias("b")), "dst")
    return n.select("node_id"), e.where("a = b").select("src", "dst")


@query(f"WITH {_KEPT}, {_LABELS} SELECT node AS node_id, c AS component FROM d10")
def components(spark, d):
    return network.components(*_regional(spark, d))


@query(f"""WITH {_KEPT}, {_LABELS}, sizes AS (SELECT c, count(*) AS n FROM d10 GROUP BY c),
h AS (SELECT node, c FROM d10 JOIN homes USING (node)), p AS (SELECT node, facility_type, c FROM d10 JOIN places USING (node))
SELECT (SELECT sum(n) FROM sizes)::BIGINT AS n_nodes, (SELECT count(*) FROM kept)::BIGINT // 2 AS n_edges, (SELECT count(*) FROM sizes) AS n_components,
       round((SELECT max(n) / sum(n) FROM sizes), 6) AS largest_component_share, (SELECT count(*) FROM h) AS n_habitations,
       round((SELECT avg(CASE WHEN c IN (SELECT c FROM p WHERE facility_type = 'health') THEN 1.0 ELSE 0.0 END) FROM h), 6) AS share_habitations_with_health,
       (SELECT count(DISTINCT node) FROM p) AS n_facilities, (SELECT count(DISTINCT node) FROM p WHERE c NOT IN (SELECT c FROM h)) AS n_orphan_facilities,
       0.95::DOUBLE AS min_health_reach, (SELECT avg(CASE WHEN c IN (SELECT c FROM p WHERE facility_type = 'health') THEN 1.0 ELSE 0.0 END) FROM h) >= 0.95 AS passes""")
def network_qa(spark, d):
    nodes, edges = _regional(spark, d)
    return rounded(network.qa_report(nodes, edges, T.places(spark, d), T.homes(spark, d)), "largest_component_share", "share_habitations_with_health")


# --- access -----------------------------------------------------------------------------------

def _times_sql(sets: str, rounds: int = 24) -> str:
    """Least times by set, type and node; ``sets``: (set_id, node) of failures, and ``set_ids``."""
    first = "SELECT s.set_id, p.facility_type, p.node, 0.0::DOUBLE AS t FROM set_ids s CROSS JOIN places p WHERE NOT EXISTS (SELECT 1 FROM fails f WHERE f.set_id = s.set_id AND f.node = p.node)"
    step = """SELECT set_id, facility_type, node, min(t) AS t FROM (SELECT * FROM {prev} UNION ALL
        SELECT p.set_id, p.facility_type, a.b, p.t + a.w FROM {prev} p JOIN arcs a ON a.a = p.node WHERE NOT EXISTS (SELECT 1 FROM fails f WHERE f.set_id = p.set_id AND f.node = a.b)) GROUP BY ALL"""
    return f"{EDGES}, {sets}, {_chain(rounds, first, step)}"


_NONE = "set_ids AS (SELECT '' AS set_id), fails AS (SELECT '' AS set_id, -1 AS node)"
_SOLO = "set_ids AS (SELECT '' AS set_id UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 3), fails AS (SELECT CAST(n_nationkey AS VARCHAR) AS set_id, n_nationkey AS node FROM nation WHERE n_regionkey = 3)"
_ALL = "set_ids AS (SELECT '' AS set_id UNION ALL SELECT 'all'), fails AS (SELECT 'all' AS set_id, n_nationkey AS node FROM nation WHERE n_regionkey = 3)"
_LOSS = """SELECT s.set_id, round(sum(population * weight * greatest(0, coalesce(least(x.t / cap_min, 1), 1) - coalesce(least(y.t / cap_min, 1), 1))), 6) AS loss
FROM set_ids s CROSS JOIN services k CROSS JOIN homes h
LEFT JOIN d24 x ON x.set_id = s.set_id AND x.facility_type = k.facility_type AND x.node = h.node
LEFT JOIN d24 y ON y.set_id = '' AND y.facility_type = k.facility_type AND y.node = h.node WHERE s.set_id <> '' GROUP BY s.set_id"""


@query(f"WITH {_times_sql(_NONE)} SELECT facility_type, node, round(t, 6) AS dist FROM d24")
def shortest_path(spark, d):
    base = access.sources_of(spark.createDataFrame([("",)], "set_id string"), T.places(spark, d))
    return rounded(access.distances(T.edges(spark, d), base).select("facility_type", "node", "dist"), "dist")


def _loss(spark, d, failed: DataFrame) -> DataFrame:
    out = access.losses(T.edges(spark, d), T.homes(spark, d), T.places(spark, d), T.services(spark), failed.select("set_id"), failed)
    return rounded(out, "loss")


@query(f"WITH {_times_sql(_SOLO)} {_LOSS}")
def access_loss_solo(spark, d):
    return _loss(spark, d, T.structures(spark, d).select(F.col("node").cast("string").alias("set_id"), "node"))


@query(f"WITH {_times_sql(_ALL)} {_LOSS}")
def access_loss_set(spark, d):
    return _loss(spark, d, T.structures(spark, d).select(F.lit("all").alias("set_id"), "node"))


@query(f"""WITH {EDGES}, asked AS (SELECT DISTINCT o_custkey % 40 AS a, o_orderkey % 30 AS b FROM orders),
nodes AS (SELECT src AS n FROM edges UNION SELECT dst FROM edges UNION SELECT node FROM homes UNION SELECT node FROM places)
SELECT DISTINCT 'node' AS what, CAST(a AS VARCHAR) AS a, '' AS b FROM asked WHERE a NOT IN (SELECT n FROM nodes)
UNION ALL SELECT DISTINCT 'edge', CAST(least(a, b) AS VARCHAR), CAST(greatest(a, b) AS VARCHAR) FROM asked WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = least(a, b) AND dst = greatest(a, b))""")
def unknown_failures(spark, d):
    """What orders name as failed - a node by customer, an edge to the order's - and the network doesn't have."""
    o = T.read(spark, d, "orders").select((F.col("o_custkey") % 40).alias("node"), (F.col("o_orderkey") % 30).alias("dst"))
    lost = access.unknown(T.edges(spark, d), T.homes(spark, d), T.places(spark, d), o.select("node"), o.select(F.col("node").alias("src"), "dst"))
    return lost.select("what", "a", F.coalesce("b", F.lit("")).alias("b"))


_SUBSETS = """names AS (SELECT n_nationkey AS node, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation WHERE n_regionkey = 3),
set_ids AS (SELECT '' AS set_id UNION ALL SELECT CAST(m AS VARCHAR) FROM range(32) t(m)), fails AS (SELECT CAST(m AS VARCHAR) AS set_id, node FROM range(32) t(m), names WHERE (m >> i) & 1 = 1)"""
#: The loss of each set of the structures, by mask, after the chain of times.
SUBSETS = f"{_times_sql(_SUBSETS)}, subset AS (SELECT CAST(set_id AS BIGINT) AS mask, loss FROM ({_LOSS.replace('round(sum(', 'sum(', 1).replace(', 6) AS loss', ' AS loss', 1)}))"


@query(f"WITH {SUBSETS} SELECT mask, round(loss, 6) AS loss FROM subset")
def access_loss_subsets(spark, d):
    """L(F) of every subset of the structures, each solved inside its row."""
    graph = access.Graph.collect(T.edges(spark, d), T.homes(spark, d), T.places(spark, d), T.services(spark))
    nodes = [n for n in sorted(r[0] for r in T.structures(spark, d).collect()) if n in graph.names]
    sets = access.subsets(spark, len(nodes))
    return rounded(sets.join(graph.set_losses(sets, nodes), "failed").select("mask", "loss"), "loss")


@query(f"""WITH {_times_sql(_ALL)} SELECT y.facility_type, y.node FROM homes h JOIN d24 y ON y.set_id = '' AND y.node = h.node
LEFT JOIN d24 x ON x.set_id = 'all' AND x.facility_type = y.facility_type AND x.node = y.node WHERE x.t IS NULL OR x.t > y.t + 1e-9""")
def affected_habitations(spark, d):
    base = access.sources_of(spark.createDataFrame([("",)], "set_id string"), T.places(spark, d))
    tree = access.parents(T.edges(spark, d), access.distances(T.edges(spark, d), base))
    failed = sorted(r[0] for r in T.structures(spark, d).collect())
    return access.affected(tree, T.homes(spark, d), failed)


# --- fragility, costs, policies -----------------------------------------------------------------

@query("""SELECT o_orderkey, round(1 / (1 + exp(-(-3 + 1.2 * (o_orderkey % 4) + 2 * ln((1 + o_custkey % 30) / 10.0::DOUBLE)))), 6) AS p FROM orders""")
def failure_probability(spark, d):
    o = T.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.select("o_orderkey", r6(S.failure_probability(F.col("o_orderkey") % 4, (1 + F.col("o_custkey") % 30) / 10.0)).alias("p"))


@query("""WITH opt AS (SELECT * FROM (VALUES (0, 'none', 0.0), (1, 'minor', 0.5), (2, 'major', 2.0), (3, 'replace', 4.0)) t(j, opt, reset))
SELECT s_suppkey, opt, CAST(greatest(0, least(3, round_even(CAST(s_suppkey % 4 AS DOUBLE) - CAST(reset AS DOUBLE), 0))) AS INTEGER) AS condition FROM supplier CROSS JOIN opt""")
def apply_condition(spark, d):
    a = S.with_costs(T.assets(spark, d))
    return a.select(F.col("ord").alias("s_suppkey"), "opt", S.apply_reset(F.col("condition"), F.col("reset")).alias("condition"))


ASSETS = """opt AS (SELECT * FROM (VALUES (0, 'none', 0.0::DOUBLE, 0.0::DOUBLE), (1, 'minor', 1.0, 1.0), (2, 'major', 4.0, 2.5), (3, 'replace', 12.0, 6.0)) t(j, opt, cm, lm)),
rate AS (SELECT * FROM (VALUES ('culvert', 0.02::DOUBLE, 5.0::DOUBLE, 0), ('minor_bridge', 0.08, 20.0, 1), ('major_bridge', 0.25, 60.0, 2)) t(structure_type, base, days, k)),
assets AS (SELECT s_nationkey AS district, s_suppkey AS ord, structure_type, CAST(s_suppkey % 4 AS INTEGER) AS condition, greatest(s_acctbal, 0) AS benefit FROM supplier JOIN rate ON k = s_suppkey % 3),
costs AS (SELECT assets.*, j, opt, base * cm AS cost, days * lm AS labour FROM assets JOIN rate USING (structure_type) CROSS JOIN opt)"""


@query(f"WITH {ASSETS} SELECT ord, opt, round(cost, 6) AS cost, round(labour, 6) AS labour, round(cost * 1.8, 6) AS emergency FROM costs")
def cost_matrix(spark, d):
    return rounded(S.with_costs(T.assets(spark, d)).select("ord", "opt", "cost", "labour", S.emergency_cost(F.col("cost")).alias("emergency")), "cost", "labour", "emergency")


def _greedy_sql(candidates: str, keys: str, budget: str, crew: str) -> str:
    """The greedy fold as a recursion over the rank in each group."""
    same = " AND ".join(f"c.{k} = w.{k}" for k in keys.split(", "))
    kw = ", ".join(f"w.{k}" for k in keys.split(", "))
    fits = f"w.spent + c.cost <= {budget} + 1e-9 AND w.used + c.labour <= {crew} + 1e-9"
    return f"""WITH RECURSIVE {ASSETS}, cand AS ({candidates}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY key DESC, ord) AS i FROM cand WHERE cost > 0 AND key > 0),
    walk AS (SELECT DISTINCT {keys}, 0::BIGINT AS i, 0.0::DOUBLE AS spent, 0.0::DOUBLE AS used, FALSE AS took FROM ranked
        UNION ALL SELECT {kw}, c.i, CASE WHEN {fits} THEN w.spent + c.cost ELSE w.spent END, CASE WHEN {fits} THEN w.used + c.labour ELSE w.used END, {fits}
        FROM walk w JOIN ranked c ON {same} AND c.i = w.i + 1)
    SELECT c.district, c.ord, c.opt, round(c.cost, 6) AS cost, round(c.labour, 6) AS labour FROM ranked c JOIN walk w ON {same} AND c.i = w.i WHERE w.took"""


def _greedy(candidates: DataFrame, keys: list[str], budget: Column | float, crew: Column | float) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    own = candidates.withColumns({"budget": as_col(budget), "crew": as_col(crew)})
    return rounded(policies.greedy_select(own, keys, "budget", "crew").select("district", "ord", "opt", "cost", "labour"), "cost", "labour")


def _suited(spark, d):
    """Each asset with the option that suits its condition."""
    return S.with_costs(T.assets(spark, d)).where(F.col("opt_ord") == S.default_option(F.col("condition")))


@query(_greedy_sql("SELECT *, condition / cost AS key FROM costs WHERE j = condition AND j > 0", "district", "2.0", "300.0"))
def greedy_worst_first(spark, d):
    c = _suited(spark, d)
    return _greedy(c.withColumn("key", F.try_divide(F.col("condition").cast("double"), F.col("cost"))), ["district"], 2.0, 300.0)


@query(_greedy_sql("SELECT *, benefit / cost AS key FROM costs WHERE j = 1", "district", "0.3", "100.0"))
def greedy_benefit_cost(spark, d):
    c = S.with_costs(T.assets(spark, d)).where("opt_ord > 0").withColumn("key", F.col("benefit") / F.col("cost"))
    best = c.groupBy("district", "ord").agg(F.max_by(F.struct("opt", "cost", "labour", "key"), F.struct("key", -F.col("opt_ord"))).alias("b"))
    return _greedy(best.select("district", "ord", "b.*"), ["district"], 0.3, 100.0)


@query(_greedy_sql("SELECT *, condition * (1.0::DOUBLE + condition) / cost AS key FROM costs WHERE j = condition AND j > 0", "district", "2.0", "300.0"))
def greedy_criticality(spark, d):
    c = _suited(spark, d)
    return _greedy(c.withColumn("key", F.try_divide(F.col("condition") * (1.0 + F.col("condition")), F.col("cost"))), ["district"], 2.0, 300.0)


@query(_greedy_sql("SELECT *, benefit / cost AS key FROM costs WHERE j = condition AND j > 0", "district, structure_type", "(2.0::DOUBLE / 3)", "(300.0::DOUBLE / 3)"))
def siloed(spark, d):
    c = _suited(spark, d)
    return _greedy(c.withColumn("key", F.try_divide(F.col("benefit"), F.col("cost"))), ["district", "structure_type"], F.lit(2.0) / 3, F.lit(300.0) / 3)


_LCG = "(({0}) % 2147483648 * 1103515245 + 12345) % 2147483648"
_U = lambda k: f"({_LCG.format(_LCG.format(_LCG.format(k)))}) / 2147483648.0::DOUBLE"


@query(_greedy_sql(f"SELECT *, 1 - {_U('ord')} AS key FROM costs WHERE j = 1 AND benefit > 0", "district", "0.3", "100.0"))
def random_policy(spark, d):
    c = S.with_costs(T.assets(spark, d)).where("opt_ord = 1 AND benefit > 0").withColumn("key", 1 - T.uniform(F.col("ord")))
    return _greedy(c, ["district"], 0.3, 100.0)


_INSTANCE = f"""{ASSETS}, u AS (SELECT *, 1 / (1 + exp(-(-3 + 1.2 * greatest(0, least(3, round_even(CAST(condition AS DOUBLE) - CASE j WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 2.0 ELSE 4.0 END, 0))))))
    * exp(-0.35 * CASE j WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 2.0 ELSE 4.0 END) * benefit AS loss FROM costs),
inst AS (SELECT k * 2 + condition % 2 AS a, j, avg(cost) AS cost, avg(labour) AS labour, sum(loss) AS loss FROM u JOIN rate USING (structure_type) GROUP BY ALL)"""


def _instance(spark, d):
    """Six assets, one a structure type and half of the conditions, with summed losses by option."""
    a = S.with_costs(T.assets(spark, d))
    after = S.apply_reset(F.col("condition"), F.col("reset"))
    loss = S.failure_probability(after, F.lit(1.0)) * F.col("factor") * F.col("benefit")
    k = F.array_position(F.array(*(F.lit(x) for x in T.KINDS)), F.col("structure_type")) - 1
    return a.groupBy((k * 2 + F.col("condition") % 2).cast("int").alias("a"), F.col("opt_ord").alias("j")).agg(F.avg("cost").alias("cost"), F.avg("labour").alias("labour"), F.sum(loss).alias("loss"))


@query(f"""WITH {_INSTANCE}, plans AS (
    SELECT i0.j j0, i1.j j1, i2.j j2, i3.j j3, i4.j j4, i5.j j5, i0.cost + i1.cost + i2.cost + i3.cost + i4.cost + i5.cost AS cost,
           i0.labour + i1.labour + i2.labour + i3.labour + i4.labour + i5.labour AS labour, i0.loss + i1.loss + i2.loss + i3.loss + i4.loss + i5.loss AS loss
    FROM inst i0 JOIN inst i1 ON i0.a = 0 AND i1.a = 1 JOIN inst i2 ON i2.a = 2 JOIN inst i3 ON i3.a = 3 JOIN inst i4 ON i4.a = 4 JOIN inst i5 ON i5.a = 5)
SELECT CAST(t.a AS INTEGER) AS a, CAST([j0, j1, j2, j3, j4, j5][t.a + 1] AS INTEGER) AS opt, round(cost, 6) AS cost, round(labour, 6) AS labour, round(loss, 4) AS loss
FROM (SELECT * FROM plans WHERE cost <= 2 + 1e-9 AND labour <= 400 + 1e-9 ORDER BY loss, cost LIMIT 1) CROSS JOIN range(6) t(a)""")
def additive_optimum(spark, d):
    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        n = int(x.a.max()) + 1
        cost, labour, loss = (np.zeros((n, 4)) for _ in range(3))
        for m, c in ((cost, "cost"), (labour, "labour"), (loss, "loss")):
            m[x.a, x.j] = x[c]
        inst = optimize.Instance(cost, labour, loss[:, :, None])
        plan = optimize.solve(inst, 2.0, 400.0)
        c, w, v = inst.take(plan)
        return pd.DataFrame({"a": range(n), "opt": plan, "cost": c, "labour": w, "loss": v.mean()})

    out = _instance(spark, d).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, "a int, opt int, cost double, labour double, loss double")
    return rounded(out, "cost", "labour").withColumn("loss", F.round("loss", 4))


# --- tails, regret, paired comparisons ------------------------------------------------------------

LOSSES = """losses AS (SELECT l_returnflag || l_linestatus AS policy, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS s, round(sum(l_extendedprice * l_discount), 4) AS loss FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {LOSSES} SELECT policy, round(avg(loss), 4) AS cvar FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY loss DESC) AS i, count(*) OVER (PARTITION BY policy) AS n FROM losses)
WHERE i <= greatest(1, ceil(n * 0.05::DOUBLE)) GROUP BY policy""")
def cvar(spark, d):
    return metrics.cvar(T.policy_losses(spark, d), "loss", ["policy"], 0.05).withColumn("cvar", F.round("cvar", 4))


@query(f"WITH {LOSSES} SELECT policy, round(quantile_cont(loss, 0.95), 2) AS var FROM losses GROUP BY policy")
def value_at_risk(spark, d):
    return T.policy_losses(spark, d).groupBy("policy").agg(F.round(metrics.value_at_risk("loss", 0.05), 2).alias("var"))


@query(f"""WITH {LOSSES}, r AS (SELECT *, loss - min(loss) OVER (PARTITION BY s) AS regret FROM losses)
SELECT policy, round(avg(CASE WHEN abs(regret) <= 1e-9 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(avg(regret), 4) AS mean_regret, round(max(regret), 4) AS max_regret FROM r GROUP BY policy""")
def regret(spark, d):
    out = metrics.robustness(T.policy_losses(spark, d).withColumnRenamed("s", "draw"))
    return out.select("policy", r6("win_rate").alias("win_rate"), F.round("mean_regret", 4).alias("mean_regret"), F.round("max_regret", 4).alias("max_regret"))


@query(f"WITH {LOSSES} SELECT s AS draw, arg_min(policy, (loss, policy)) AS winner FROM losses GROUP BY s")
def set_winners(spark, d):
    return metrics.winners(T.policy_losses(spark, d).withColumnRenamed("s", "draw").withColumn("ord", F.col("policy")))


_OUTCOMES = f"{LOSSES}, outcomes AS (SELECT policy, s, loss AS person_days, round(loss / 100, 6) AS planned, CAST(s % 7 AS DOUBLE) AS emergency FROM losses)"


def _outcomes(spark, d):
    return T.policy_losses(spark, d).select("policy", "s", F.col("loss").alias("person_days"), r6(F.col("loss") / 100).alias("planned"), (F.col("s") % 7).cast("double").alias("emergency"))


@query(f"""WITH {_OUTCOMES}, tail AS (SELECT policy, avg(person_days) AS c FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY person_days DESC) AS i, count(*) OVER (PARTITION BY policy) AS n FROM outcomes)
    WHERE i <= greatest(1, ceil(n * 0.1::DOUBLE)) GROUP BY policy)
SELECT policy, round(avg(person_days), 4) AS mean_person_days, round(stddev_pop(person_days), 4) AS sd_person_days, round(avg(planned + emergency), 4) AS mean_spend_crore,
       round(sum(person_days) / sum(planned + emergency), 4) AS person_days_per_crore, round(any_value(c), 4) AS cvar_person_days FROM outcomes JOIN tail USING (policy) GROUP BY policy""")
def policy_summary(spark, d):
    names = ["mean_person_days", "sd_person_days", "mean_spend_crore", "person_days_per_crore", "cvar_person_days"]
    return metrics.policy_summary(_outcomes(spark, d)).select("policy", *(F.round(n, 4).alias(n) for n in names))


@query(f"WITH {LOSSES} SELECT policy, round(median(loss), 4) AS median, round(min(loss), 4) AS min, round(max(loss), 4) AS max FROM losses GROUP BY policy")
def medians_ranges(spark, d):
    return metrics.medians_and_ranges(T.policy_losses(spark, d), "loss", ["policy"]).select("policy", *(F.round(n, 4).alias(n) for n in ("median", "min", "max")))


_DIFF = f"{LOSSES}, q AS (SELECT policy, year_of AS s, sum(loss) AS loss FROM (SELECT policy, loss, s // 12 AS year_of FROM losses) GROUP BY ALL), diff AS (SELECT a.s, a.loss - b.loss AS diff FROM q a JOIN q b ON a.s = b.s WHERE a.policy = (SELECT min(policy) FROM q) AND b.policy = (SELECT max(policy) FROM q))"


def _diffs(spark, d):
    """Of the first and the last policy by name, years that both have."""
    q = T.policy_losses(spark, d).groupBy("policy", F.floor(F.col("s") / 12).alias("s")).agg(F.sum("loss").alias("person_days"))
    names = q.agg(F.min("policy"), F.max("policy")).collect()[0]
    shared = q.where(F.col("policy") == names[0]).select("s").intersect(q.where(F.col("policy") == names[1]).select("s"))
    return metrics.paired(q.join(shared, "s"), names[0], names[1])


@query(f"WITH {_DIFF} SELECT CAST(s AS BIGINT) AS s, round(diff, 4) AS diff FROM diff")
def paired_diff(spark, d):
    return _diffs(spark, d).select("s", F.round("diff", 4).alias("diff"))


@query(f"""WITH {_DIFF}, ranked AS (SELECT row_number() OVER (ORDER BY s) - 1 AS i, diff FROM diff), k AS (SELECT count(*) AS k FROM diff),
draws AS (SELECT t.id % 500 AS b, CAST(floor({_U('t.id + 1')} * k) AS BIGINT) AS i FROM k, LATERAL (SELECT unnest(range(500 * k)) AS id) t),
means AS (SELECT b, avg(diff) AS m FROM draws JOIN ranked USING (i) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 3) AS lo, round(quantile_cont(m, 0.975), 3) AS hi, round(avg(m), 3) AS mean FROM means""")
def paired_bootstrap_lcg(spark, d):
    out = metrics.paired_bootstrap_portable(_diffs(spark, d), 500)
    return out.select(*(F.round(n, 3).alias(n) for n in ("lo", "hi", "mean")))


# --- hazard -------------------------------------------------------------------------------------------

MAXIMA = "maxima AS (SELECT user_id AS cell, CAST(ts AS DATE) AS block, max(value) AS value FROM events GROUP BY ALL)"
LMOM = MAXIMA + """, rk AS (SELECT cell, value, CAST(row_number() OVER (PARTITION BY cell ORDER BY value) AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY cell) AS DOUBLE) AS n FROM maxima WHERE value IS NOT NULL),
b AS (SELECT cell, count(*) AS n, avg(value) AS b0, avg(value * (i - 1) / (n - 1)) AS b1, avg(value * (i - 1) * (i - 2) / ((n - 1) * (n - 2))) AS b2 FROM rk WHERE n >= 5 GROUP BY cell),
lm AS (SELECT cell, n, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3 FROM b),
cc AS (SELECT *, 2 / (3 + l3 / l2) - ln(2) / ln(3) AS z FROM lm WHERE l2 > 0), sh AS (SELECT *, CASE WHEN abs(7.8590 * z + 2.9554 * z * z) < 1e-6 THEN 1e-6 ELSE 7.8590 * z + 2.9554 * z * z END AS c FROM cc),
fits AS (SELECT cell, n, c, l1 - (l2 * c / ((1 - 2 ** (-c)) * gamma(1 + c))) * (1 - gamma(1 + c)) / c AS loc, l2 * c / ((1 - 2 ** (-c)) * gamma(1 + c)) AS scale FROM sh)"""


@query(f"WITH {LMOM} SELECT cell, n, round(c, 5) AS c, round(loc, 4) AS loc, round(scale, 4) AS scale FROM fits")
def gev_lmoments(spark, d):
    f = hazard.fit_lmoments(hazard.pooled(T.maxima(spark, d)))
    return f.select("cell", "n", F.round("c", 5).alias("c"), F.round("loc", 4).alias("loc"), F.round("scale", 4).alias("scale"))


@query(f"""WITH {LMOM} SELECT cell, CAST(t AS DOUBLE) AS period, round(loc + scale / c * (1 - (-ln(1 - 1 / CAST(t AS DOUBLE))) ** c), 3) AS level
FROM fits CROSS JOIN (SELECT unnest([2, 5, 10, 25, 50, 100]) AS t)""")
def return_levels(spark, d):
    out = hazard.return_levels(hazard.fit_lmoments(hazard.pooled(T.maxima(spark, d))))
    return out.withColumn("level", F.round("level", 3))


@query(f"""WITH {LMOM}, g AS (SELECT rk.cell, i, rk.n, 1 - c * (value - loc) / scale AS t, c FROM rk JOIN fits USING (cell)),
f AS (SELECT *, CASE WHEN t > 0 THEN exp(-(t ** (1 / c))) WHEN c > 0 THEN 1 ELSE 0 END AS f FROM g)
SELECT cell, CAST(max(n) AS BIGINT) AS n, round(max(greatest(i / n - f, f - (i - 1) / n)), 5) AS d FROM f GROUP BY cell""")
def ks_stat(spark, d):
    rows = hazard.pooled(T.maxima(spark, d))
    return hazard.ks_distance(rows, hazard.fit_lmoments(rows)).select("cell", "n", F.round("d", 5).alias("d"))


@query()
def gev_likelihood(spark, d):
    rows = hazard.pooled(T.maxima(spark, d))
    enough = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= hazard.LEAST_YEARS)
    return hazard.fit_gev(rows.join(enough.select("cell"), "cell")).withColumns({c: F.round(c, 3) for c in ("c", "loc", "scale")})


@query(f"""WITH {MAXIMA}, blocks AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT block FROM maxima))
SELECT CAST(t.id AS INTEGER) AS scenario, cell, round(value, 6) AS value FROM range(10) t(id) JOIN blocks ON i = CAST(floor({_U('t.id + 1')} * k) AS BIGINT) JOIN maxima USING (block)""")
def resample_fields(spark, d):
    days = T.maxima(spark, d).select(F.col("block").alias("year"), "cell", "value")
    return rounded(hazard.resample_years(days, 10, portable=True), "value")


_POOLED = MAXIMA.replace("maxima AS", "own AS").replace("max(value) AS value", "max(CASE WHEN user_id % 7 <> 3 THEN value END) AS value") + """, sizes AS (SELECT cell, count(value) AS n FROM own GROUP BY cell),
maxima AS (SELECT cell, value FROM own WHERE value IS NOT NULL UNION ALL SELECT c.cell, o.value FROM sizes c JOIN own o ON abs(o.cell - c.cell) = 1 WHERE c.n < 25 AND o.value IS NOT NULL)""" + LMOM[len(MAXIMA):]


@query(f"WITH {_POOLED} SELECT cell, n, round(c, 5) AS c, round(loc, 4) AS loc, round(scale, 4) AS scale FROM fits")
def gev_pooled(spark, d):
    """Cells with few values, and those with none, borrow from the cells next to them."""
    m = T.maxima(spark, d).withColumn("value", F.when(F.col("cell") % 7 != 3, F.col("value")))
    near = m.select("cell").distinct().select("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell") + 1)).alias("neighbour"))
    f = hazard.fit_lmoments(hazard.pooled(m, near, 25))
    return f.select("cell", "n", F.round("c", 5).alias("c"), F.round("loc", 4).alias("loc"), F.round("scale", 4).alias("scale"))


@query("SELECT user_id AS cell, CAST(CAST(ts AS DATE) AS VARCHAR) AS block, round(max(value) * 1.5, 6) AS stressed, round(max(value) * (100.0::DOUBLE / 50.0), 6) AS at_level FROM events GROUP BY user_id, CAST(ts AS DATE)")
def stress_scale(spark, d):
    m = T.maxima(spark, d)
    return m.select("cell", F.col("block").cast("string").alias("block"), r6(S.stressed(F.col("value"), 1.5)).alias("stressed"), r6(S.stress_to_level(F.col("value"), 100.0, 50.0)).alias("at_level"))


# --- register -------------------------------------------------------------------------------------------

def _register_values() -> str:
    rows = ", ".join(f"({i}, '{p.name}', '{p.unit}', {p.low}::DOUBLE, {p.high}::DOUBLE, {p.default}::DOUBLE, '{p.source}')" for i, p in enumerate(Register.default().parameters.values()))
    return f"register AS (SELECT * FROM (VALUES {rows}) t(ord, name, unit, low, high, \"default\", source))"


@query(f'WITH {_register_values()} SELECT name, unit, low, high, "default", source FROM register')
def register_table(spark, d):
    return Register.default().table(spark).select("name", "unit", "low", "high", "default", "source")


@query(f"WITH {_register_values()} SELECT CAST(draw AS INTEGER) AS draw, name, round(low + (high - low) * {_U('draw * 21 + ord')}, 6) AS value FROM register CROSS JOIN range(8) t(draw)")
def register_sample_lcg(spark, d):
    table = Register.default().table(spark)
    order = {n: i for i, n in enumerate(Register.default().parameters)}
    rows = table.withColumn("ord", F.try_element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), "name"))
    wide = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(7))))
    value = F.col("low") + (F.col("high") - F.col("low")) * T.uniform(F.col("draw") * 21 + F.col("ord"))
    return wide.select("draw", "name", r6(value).alias("value"))
