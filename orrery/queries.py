"""Queries of the engine over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosted
from .estimators import Classifier, class_number
from .functions import frame_objectives as W
from .functions import metrics as M
from .functions import objectives as O
from .operators import eras as E
from .operators import bundling, ordered
from .operators import tree as T
from .operators.splits import Nodes, Rule
from .sources.tables import categorical_columns, panel, read

Q, S = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def orders(spark: SparkSession, d: str) -> DataFrame:
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").cast("long").alias("row_id"), F.date_format("o_orderdate", "yyyy-MM").alias("era"), F.col("o_totalprice").alias("x"), F.col("c_acctbal").alias("y"), F.col("o_orderpriority").alias("cat"), F.col("o_custkey").cast("long").alias("cust"), (F.col("o_orderstatus") == "F").cast("int").alias("event"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("days"))


P = """p AS (SELECT CAST(o_orderkey AS BIGINT) AS row_id, strftime(o_orderdate, '%Y-%m') AS era, o_totalprice AS x, c_acctbal AS y, o_orderpriority AS cat, CAST(o_custkey AS BIGINT) AS cust,
 CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders JOIN customer ON o_custkey = c_custkey)"""

FEATURES = ["l_quantity", "l_discount", "l_tax"]
#: Bins of the split queries: fixed edges, so that both engines cut alike.
EDGES = {"l_quantity": [5.5, 10.5, 15.5, 20.5, 25.5, 30.5, 35.5, 40.5, 45.5], "l_discount": [0.015, 0.035, 0.055, 0.075], "l_tax": [0.015, 0.035, 0.055]}
_CELL = {f: " + ".join(f"CAST({f} >= {e} AS INT)" for e in edges) for f, edges in EDGES.items()}
B = f"""m AS (SELECT avg(l_extendedprice) AS mean FROM lineitem),
b AS (SELECT m.mean - l_extendedprice AS g, [{', '.join(_CELL[f] for f in FEATURES)}] AS bins FROM lineitem, m),
r AS (SELECT g, unnest(bins) AS bin, unnest([0, 1, 2]) AS feature FROM b),
hist AS (SELECT feature, bin, sum(g) AS g, CAST(count(*) AS DOUBLE) AS h, count(*) AS c FROM r GROUP BY 1, 2)"""


def binned(spark, d):
    li = read(spark, d, "lineitem")
    mean = li.agg(F.avg("l_extendedprice")).first()[0]
    bins = T.bin_column([F.col(f) for f in FEATURES], [EDGES[f] for f in FEATURES], 255)
    return li.select(*FEATURES, "l_extendedprice", (F.lit(mean) - F.col("l_extendedprice")).alias("g"), F.lit(1.0).alias("h"), bins.alias("bins"))


def _root(spark, d):
    return T.node_histograms(binned(spark, d), Nodes([(-1, 0, 0, -1, -1)], 255), [0], len(FEATURES))[0]


@query("""WITH q AS (SELECT o_totalprice AS v FROM orders), c AS (SELECT c_nationkey AS v FROM customer), n AS (SELECT count(DISTINCT v) AS n FROM c)
SELECT 'o_totalprice' AS feature, edge FROM (SELECT DISTINCT round(unnest(quantile_cont(v, [1/16, 2/16, 3/16, 4/16, 5/16, 6/16, 7/16, 8/16, 9/16, 10/16, 11/16, 12/16, 13/16, 14/16, 15/16])), 6) AS edge FROM q)
UNION ALL SELECT 'c_mktsegment_length' AS feature, edge FROM (SELECT DISTINCT round(unnest(quantile_cont(v, [0.25, 0.5, 0.75])), 6) AS edge FROM (SELECT CAST(c_nationkey % 4 AS DOUBLE) AS v FROM customer))""")
def bin_edges(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer").select((F.col("c_nationkey") % 4).cast("double").alias("v"))
    rows = [("o_totalprice", e) for e in T.bin_edges(o, ["o_totalprice"], 16, exact=True)["o_totalprice"]]
    rows += [("c_mktsegment_length", e) for e in T.bin_edges(c, ["v"], 255, exact=True)["v"]]
    return spark.createDataFrame(rows, "feature string, edge double").select("feature", F.round("edge", 6).alias("edge"))


@query(f"WITH {B} SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, count(*) AS c FROM r GROUP BY 1, 2")
def bin_digitize(spark, d):
    return binned(spark, d).select(F.posexplode("bins").alias("feature", "bin")).groupBy("feature", F.col("bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))


@query(f"WITH {B} SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, round(g, 2) AS g, h, c FROM hist")
def grad_histogram(spark, d):
    import numpy as np

    g, h, c = _root(spark, d)
    rows = [(int(f), int(b), float(g[f, b]), float(h[f, b]), int(c[f, b])) for f, b in zip(*np.nonzero(c), strict=True)]
    return rounded(spark.createDataFrame(rows, "feature int, bin int, g double, h double, c long"), "g", digits=2)


GAINS = B + """, s AS (SELECT feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(c) OVER w AS cl, sum(g) OVER v AS gt, sum(h) OVER v AS ht FROM hist
 WINDOW w AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY feature)),
gains AS (SELECT feature, bin, cl, gl, hl, gt, ht, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM s WHERE hl >= 1 AND ht - hl >= 1)"""


def _gains(spark, d):
    hist = _root(spark, d)
    there = spark.createDataFrame([(int(f), int(b)) for f in range(len(FEATURES)) for b in range(255) if hist[2][f, b] > 0], "feature int, bin int")
    return T.gain_table(spark, hist, Rule()).where("nan_dir = 0").join(there, ["feature", "bin"])


@query(f"WITH {GAINS} SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, round(gain / 1e6, 4) AS gain_m, CAST(cl AS BIGINT) AS n_left FROM gains ORDER BY gain DESC, feature, bin LIMIT 3")
def best_split(spark, d):
    top = _gains(spark, d).orderBy(F.desc("gain"), "feature", "bin").limit(3)
    return top.select("feature", "bin", F.round(F.col("gain") / 1e6, 4).alias("gain_m"), F.col("cl").alias("n_left"))


@query(f"WITH {GAINS} SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, round(-gl / (hl + 1), 4) AS left_value, round(-(gt - gl) / (ht - hl + 1), 4) AS right_value FROM gains")
def node_leaf_values(spark, d):
    return rounded(_gains(spark, d).select("feature", "bin", "left_value", "right_value"), "left_value", "right_value", digits=4)


def _order_bins(spark, d):
    o = orders(spark, d)
    mean = o.agg(F.avg("y").alias("m"))
    return o.crossJoin(F.broadcast(mean)).select("era", (F.col("m") - F.col("y")).alias("g"), F.lit(1.0).alias("h"), F.array(F.least(F.floor(F.col("x") / 100000), F.lit(4)).cast("int"), F.pmod("row_id", F.lit(4)).cast("int")).alias("bins"))


OB = P + """, om AS (SELECT avg(y) AS m FROM p), ob AS (SELECT era, m - y AS g, unnest([CAST(least(floor(x / 100000), 4) AS INT), CAST(row_id % 4 AS INT)]) AS bin, unnest([0, 1]) AS feature FROM p, om),
eh AS (SELECT era, feature, bin, sum(g) AS g, CAST(count(*) AS DOUBLE) AS h, count(*) AS c FROM ob GROUP BY 1, 2, 3)"""


@query(f"WITH {OB} SELECT era, CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, round(g, 4) AS g, h, c FROM eh")
def era_histogram(spark, d):
    return rounded(T.histogram(_order_bins(spark, d), "bins", ["era"]), "g", digits=4)


@query(f"""WITH {OB}, cells AS (SELECT DISTINCT feature, bin FROM eh), es AS (SELECT DISTINCT era FROM eh),
f AS (SELECT es.era, cells.feature, cells.bin, coalesce(g, 0) AS g, coalesce(h, 0) AS h FROM es CROSS JOIN cells LEFT JOIN eh ON eh.era = es.era AND eh.feature = cells.feature AND eh.bin = cells.bin),
s AS (SELECT era, feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER v AS gt, sum(h) OVER v AS ht FROM f WINDOW w AS (PARTITION BY era, feature ORDER BY bin ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY era, feature)),
t AS (SELECT feature, bin, CASE WHEN hl > 1e-6 THEN -gl / (hl + 1) END AS l, CASE WHEN ht - hl > 1e-6 THEN -(gt - gl) / (ht - hl + 1) END AS r FROM s)
SELECT CAST(feature AS INT) AS feature, CAST(bin AS INT) AS bin, round(coalesce(var_pop(l), 0) + coalesce(var_pop(r), 0), 3) AS penalty FROM t GROUP BY 1, 2""")
def era_split_penalty(spark, d):
    return rounded(T.era_penalty(T.histogram(_order_bins(spark, d), "bins", ["era"])).where("nan_dir = 0").drop("nan_dir"), "penalty", digits=3)


@query(f"WITH {P}, m AS (SELECT avg(y) AS mean FROM p) SELECT row_id, round((coalesce(sum(y) OVER w, 0) + mean * 10) / (count(y) OVER w + 10), 6) AS encoded FROM p, m WINDOW w AS (PARTITION BY cat ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def target_encode_ordered(spark, d):
    return rounded(T.ordered_target(orders(spark, d), "cat", "y", "row_id").select("row_id", "encoded"), "encoded")


@query(f"WITH {P}, m AS (SELECT avg(y) AS mean FROM p) SELECT row_id, round((coalesce(sum(y) OVER w, 0) + mean * 10) / (count(y) OVER w + 10), 6) AS encoded FROM p, m WINDOW w AS (PARTITION BY cat ORDER BY {boosted.mix_sql('row_id', 7)}, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def target_encode_permuted(spark, d):
    return rounded(T.ordered_target(orders(spark, d), "cat", "y", "row_id", seed=7).select("row_id", "encoded"), "encoded")


@query(f"WITH {P}, m AS (SELECT avg(y) AS mean FROM p WHERE row_id % 2 = 0), k AS (SELECT cust, (sum(y) + any_value(mean) * 10) / (count(*) + 10) AS encoded FROM p, m WHERE row_id % 2 = 0 GROUP BY cust) SELECT row_id, round(coalesce(encoded, mean), 6) AS encoded FROM p CROSS JOIN m LEFT JOIN k ON k.cust = p.cust WHERE row_id % 2 = 1")
def target_encode_unseen(spark, d):
    """Rows of odd id are encoded by a table of the others: the split into training and new rows is what is shown."""
    o = orders(spark, d)
    seen, new = o.where("row_id % 2 = 0"), o.where("row_id % 2 = 1")
    mean = seen.agg(F.avg("y")).first()[0]
    return rounded(T.target_lookup(new, T.target_table(seen, "cust", "y"), "cust", mean).select("row_id", "encoded"), "encoded")


@query(f"WITH {P}, m AS (SELECT avg(y) AS mean FROM p) SELECT cat, round((sum(y) + any_value(mean) * 10) / (count(*) + 10), 6) AS encoded FROM p, m GROUP BY cat")
def target_encode_lookup(spark, d):
    return rounded(T.target_table(orders(spark, d), "cat", "y"), "encoded")


RHO = P + """, k AS (SELECT era, CAST(row_number() OVER (PARTITION BY era ORDER BY x, row_id) AS DOUBLE) AS rx, CAST(row_number() OVER (PARTITION BY era ORDER BY y, row_id) AS DOUBLE) AS ry FROM p),
rho AS (SELECT era, count(*) AS n, CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) ELSE 0 END AS rho FROM k GROUP BY era)"""


def _rhos(spark, d):
    return E.era_spearman(orders(spark, d), "era", "x", "y", "row_id")


@query(f"WITH {RHO} SELECT era, n, round(rho, 6) AS rho FROM rho")
def era_spearman(spark, d):
    return rounded(_rhos(spark, d), "rho")


@query(f"WITH {RHO} SELECT round(avg(rho), 6) AS mean_corr, round(stddev_pop(rho), 6) AS std_corr, round(avg(rho) / (stddev_pop(rho) + 1e-9), 6) AS sharpe, arg_min(era, rho) AS worst_era FROM rho WHERE n >= 2")
def era_sharpe(spark, d):
    return rounded(E.era_sharpe(_rhos(spark, d)), "mean_corr", "std_corr", "sharpe")


def _weights_sql(raw: str) -> str:
    return f"WITH {RHO}, st AS (SELECT avg(rho) AS mu, stddev_pop(rho) + 1e-9 AS sd, count(*) AS k, sum(n) AS t FROM rho), e AS (SELECT era, n, t, {raw} AS w FROM rho, st), z AS (SELECT era, n, t, w / sum(w) OVER () AS w FROM e) SELECT era, round(w, 6) AS weight, round(w * t / n, 6) AS row_weight FROM z"


def _weights(method):
    return lambda spark, d: rounded(E.era_weights(_rhos(spark, d), method), "weight", "row_weight")


@query(f"WITH {RHO}, e AS (SELECT era, n, sum(n) OVER () AS t, greatest(exp(-rho) / sum(exp(-rho)) OVER (), 0.9 / count(*) OVER ()) AS w FROM rho), z AS (SELECT era, n, t, w / sum(w) OVER () AS w FROM e) SELECT era, round(w, 6) AS weight, round(w * t / n, 6) AS row_weight FROM z")
def era_weights_floor(spark, d):
    return rounded(E.era_weights(_rhos(spark, d), "hard_era", floor=0.9), "weight", "row_weight")


@query(f"""WITH {P}, k AS (SELECT row_id, era, y, unnest([0, 1]) AS round, unnest([x, CAST(days AS DOUBLE)]) AS v FROM p), q AS (SELECT round, era, CAST(row_number() OVER (PARTITION BY round, era ORDER BY v, row_id) AS DOUBLE) AS rx, CAST(row_number() OVER (PARTITION BY round, era ORDER BY y, row_id) AS DOUBLE) AS ry FROM k),
e AS (SELECT round, era, CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) ELSE 0 END AS rho FROM q GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT CAST(round AS INT) AS round, round(avg(rho), 6) AS mean_corr, round(stddev_pop(rho), 6) AS std_corr, round(avg(rho) / (stddev_pop(rho) + 1e-9), 6) AS sharpe, arg_min(era, rho) AS worst_era FROM e GROUP BY 1""")
def era_history(spark, d):
    o = orders(spark, d).withColumn("days", F.col("days").cast("double"))
    return rounded(E.era_history([E.era_spearman(o, "era", x, "y", "row_id") for x in ("x", "days")]), "mean_corr", "std_corr", "sharpe")


for _name, _method, _raw in (("era_weights_hard", "hard_era", "exp(-rho)"), ("era_weights_sharpe", "sharpe_reweight", "exp(1 / (k * sd) - mu * (rho - mu) / (k * sd * sd * sd))"), ("era_weights_prop", "proportional", "greatest(1 - abs(rho), 1e-6)")):
    Q[_name], S[_name] = _weights(_method), _weights_sql(_raw)


@query(f"WITH {P} SELECT row_id, round(2.0 * (row_number() OVER (PARTITION BY era ORDER BY x, row_id) - 1) / greatest(count(*) OVER (PARTITION BY era) - 1, 1) - 1, 6) AS normed FROM p")
def rank_normalize(spark, d):
    return rounded(E.rank_normalize(orders(spark, d), "x", "row_id", "era").select("row_id", "normed"), "normed")


@query(f"""WITH {P}, m AS (SELECT era, median(y) AS m, count(*) AS n FROM p GROUP BY era), s AS (SELECT era, median(abs(y - m)) AS mad, any_value(n) AS n FROM p JOIN m USING (era) GROUP BY era)
SELECT row_id, round(CASE WHEN n < 2 THEN y ELSE sign(y) * least(abs(y), mad * 1.5) END, 6) AS clipped FROM p JOIN s USING (era)""")
def mad_clip(spark, d):
    return rounded(E.mad_clip(orders(spark, d), "era", "y", 1.5).select("row_id", "clipped"), "clipped")


@query(f"WITH {P} SELECT row_id, round(0.2 * (2 * y - coalesce(lag(y) OVER w, y) - coalesce(lead(y) OVER w, y)), 6) AS tgrad FROM p WINDOW w AS (PARTITION BY cust ORDER BY row_id)")
def temporal_gradient(spark, d):
    return rounded(E.temporal_gradient(orders(spark, d), "row_id", "y", 0.1, ["cust"]).select("row_id", "tgrad"), "tgrad")


@query(f"WITH {P} SELECT round(covar_pop(x, y) / ((stddev_pop(x) + 1e-9) * (stddev_pop(y) + 1e-9)), 6) AS exposure_y, round(covar_pop(x, days) / ((stddev_pop(x) + 1e-9) * (stddev_pop(days) + 1e-9)), 6) AS exposure_days FROM p")
def exposure(spark, d):
    return rounded(E.exposure(orders(spark, d), "x", ["y", "days"]), "exposure_y", "exposure_days")


@query(f"WITH {P} SELECT era, round(coalesce(covar_pop(x, y) / ((stddev_pop(x) + 1e-9) * (stddev_pop(y) + 1e-9)), 0), 6) AS exposure_y FROM p GROUP BY era")
def exposure_per_era(spark, d):
    return rounded(E.exposure(orders(spark, d), "x", ["y"], ["era"]), "exposure_y")


@query(f"""WITH {P}, g AS (SELECT sum(y * y) + 1e-8 AS a, sum(y * days) AS b, sum(days * days) + 1e-8 AS c, sum(y * x) AS u, sum(days * x) AS v FROM p),
w AS (SELECT (c * u - b * v) / (a * c - b * b) AS b0, (a * v - b * u) / (a * c - b * b) AS b1 FROM g) SELECT row_id, round(x - b0 * y - b1 * days, 3) AS neutral FROM p, w""")
def neutralize(spark, d):
    return rounded(E.neutralize(orders(spark, d), "x", ["y", "days"]).select("row_id", "neutral"), "neutral", digits=3)


@query(f"""WITH {P}, g AS (SELECT era, count(*) AS n, sum(y * x) / (sum(y * y) + 1e-8) AS b FROM p GROUP BY era) SELECT row_id, round(x - CASE WHEN n > 1 THEN b ELSE 0 END * y, 3) AS neutral FROM p JOIN g USING (era)""")
def neutralize_per_era(spark, d):
    return rounded(E.neutralize_by_era(orders(spark, d), "era", "row_id", "x", ["y"]), "neutral", digits=3)


def _predicted(spark, d):
    o = orders(spark, d)
    return o.join(F.broadcast(o.groupBy("cat").agg(F.avg("x").alias("pred"))), "cat")


PRED = P + ", c AS (SELECT cat, avg(x) AS pred FROM p GROUP BY cat), v AS (SELECT p.*, pred FROM p JOIN c USING (cat))"


@query(f"WITH {PRED}, k AS (SELECT count(*) AS n, list_sort(list(abs(x - pred))) AS r FROM v), a AS (SELECT n, r, least(ceil((n + 1) * 0.9) / n, 1.0) * (n - 1) AS t FROM k) SELECT n, round(r[CAST(floor(t) AS INT) + 1] + (r[CAST(least(floor(t) + 1, n - 1) AS INT) + 1] - r[CAST(floor(t) AS INT) + 1]) * (t - floor(t)), 3) AS q FROM a")
def conformal_q(spark, d):
    return rounded(E.conformal(_predicted(spark, d), "x", "pred", 0.1), "q", digits=3)


ERAQ = PRED + """, k AS (SELECT era, count(*) AS n, list_sort(list(abs(x - pred))) AS r FROM v GROUP BY era HAVING count(*) >= 20), a AS (SELECT era, n, r, least(ceil((n + 1) * 0.9) / n, 1.0) * (n - 1) AS t FROM k),
eq AS (SELECT era, n, r[CAST(floor(t) AS INT) + 1] + (r[CAST(least(floor(t) + 1, n - 1) AS INT) + 1] - r[CAST(floor(t) AS INT) + 1]) * (t - floor(t)) AS q FROM a)"""


@query(f"WITH {ERAQ} SELECT era, n, round(q, 3) AS q FROM eq")
def conformal_era_q(spark, d):
    return rounded(E.conformal(_predicted(spark, d), "x", "pred", 0.1, ["era"]), "q", digits=3)


_GLOBAL = "gk AS (SELECT count(*) AS n, list_sort(list(abs(x - pred))) AS r FROM v), ga AS (SELECT n, r, least(ceil((n + 1) * 0.9) / n, 1.0) * (n - 1) AS t FROM gk), gq AS (SELECT r[CAST(floor(t) AS INT) + 1] + (r[CAST(least(floor(t) + 1, n - 1) AS INT) + 1] - r[CAST(floor(t) AS INT) + 1]) * (t - floor(t)) AS gq FROM ga)"


@query(f"WITH {ERAQ}, {_GLOBAL} SELECT v.era, count(*) AS n, round(avg(CASE WHEN abs(x - pred) <= coalesce(q, gq) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM v CROSS JOIN gq LEFT JOIN eq ON eq.era = v.era GROUP BY 1")
def conformal_coverage(spark, d):
    v = _predicted(spark, d)
    return rounded(E.Conformal(0.1, era="era").calibrate(v, "x", "pred").coverage(v, "x", "pred", ["era"]), "coverage")


@query(f"""WITH {PRED}, k AS (SELECT count(*) AS n, list_sort(list(greatest(x - pred, 0))) AS u, list_sort(list(greatest(pred - x, 0))) AS l FROM v), a AS (SELECT *, least(ceil((n + 1) * 0.95) / n, 1.0) * (n - 1) AS t FROM k),
q AS (SELECT u[CAST(floor(t) AS INT) + 1] + (u[CAST(least(floor(t) + 1, n - 1) AS INT) + 1] - u[CAST(floor(t) AS INT) + 1]) * (t - floor(t)) AS up, l[CAST(floor(t) AS INT) + 1] + (l[CAST(least(floor(t) + 1, n - 1) AS INT) + 1] - l[CAST(floor(t) AS INT) + 1]) * (t - floor(t)) AS lo FROM a)
SELECT row_id, round(pred - lo, 3) AS lower, round(pred + up, 3) AS upper FROM v, q""")
def conformal_asymmetric(spark, d):
    v = _predicted(spark, d)
    return rounded(E.Conformal(0.1, asymmetric=True).calibrate(v, "x", "pred").predict_interval(v, "pred").select("row_id", "lower", "upper"), "lower", "upper", digits=3)


@query(f"WITH {P} SELECT round(greatest(abs(covar_pop(x, y) / ((stddev_pop(x) + 1e-9) * (stddev_pop(y) + 1e-9))), abs(covar_pop(x, days) / ((stddev_pop(x) + 1e-9) * (stddev_pop(days) + 1e-9)))), 6) AS max_exposure FROM p")
def max_exposure(spark, d):
    return rounded(E.max_exposure(orders(spark, d), "x", ["y", "days"]), "max_exposure")


@query(f"WITH {P}, e AS (SELECT era, CASE WHEN count(*) < 2 THEN 0 ELSE abs(covar_pop(x, y) / ((stddev_pop(x) + 1e-9) * (stddev_pop(y) + 1e-9))) END AS a, CASE WHEN count(*) < 2 THEN 0 ELSE abs(covar_pop(x, days) / ((stddev_pop(x) + 1e-9) * (stddev_pop(days) + 1e-9))) END AS b FROM p GROUP BY era) SELECT round(avg(a), 6) AS exposure_y, round(avg(b), 6) AS exposure_days FROM e")
def mean_exposure(spark, d):
    return rounded(E.mean_exposure(orders(spark, d), "x", ["y", "days"], "era"), "exposure_y", "exposure_days")


@query(f"WITH {P}, k AS (SELECT cust, y - lag(y) OVER (PARTITION BY cust ORDER BY row_id) AS d FROM p) SELECT cust, round(0.1 * coalesce(sum(d * d), 0), 6) AS penalty FROM k GROUP BY cust")
def temporal_penalty(spark, d):
    return rounded(E.temporal_penalty(orders(spark, d), "row_id", "y", 0.1, ["cust"]), "penalty")


@query(f"WITH {P} SELECT cat, round(0.5 * var_pop(y / 1000), 6) AS penalty FROM p GROUP BY cat")
def gain_variance(spark, d):
    return rounded(E.gain_variance(orders(spark, d).withColumn("gain", F.col("y") / 1000), ["cat"], "gain"), "penalty")


@query(f"""WITH {P}, m AS (SELECT era, median(y) AS m FROM p GROUP BY era), s AS (SELECT era, count(*) AS n, median(abs(y - m)) AS mad FROM p JOIN m USING (era) GROUP BY era)
SELECT era, round(CASE WHEN n < 2 THEN 0 ELSE any_value(mad) END, 6) AS mad, round(CASE WHEN n < 2 THEN 0 ELSE avg(CASE WHEN abs(y) > mad * 1.5 THEN 1.0 ELSE 0.0 END) END, 6) AS frac_clipped FROM p JOIN s USING (era) GROUP BY era, n""")
def clip_stats(spark, d):
    return rounded(E.clip_stats(orders(spark, d), "era", "y", 1.5).select("era", "mad", "frac_clipped"), "mad", "frac_clipped")


DAYS = "daily AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1)"


def _daily(spark, d):
    return read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))


@query(f"WITH {DAYS}, r AS (SELECT day, CASE WHEN row_number() OVER (ORDER BY day) >= 5 THEN stddev_pop(v) OVER (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS vol FROM daily) SELECT CAST(day AS VARCHAR) AS day, round(vol, 4) AS vol, CAST(CASE WHEN vol > 1000 THEN 1 ELSE 0 END + CASE WHEN vol > 2000 THEN 1 ELSE 0 END AS INT) AS regime FROM r")
def rolling_regimes(spark, d):
    return rounded(E.regimes(E.rolling_std(_daily(spark, d), "day", "v", 5), [1000.0, 2000.0]).select(F.col("day").cast("string").alias("day"), "vol", "regime"), "vol", digits=4)


@query(f"WITH {DAYS}, k AS (SELECT day, v, max(v) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS peak FROM daily) SELECT round(max((peak - v) / CASE WHEN peak > 0 THEN peak ELSE 1 END), 6) AS max_drawdown FROM k")
def drawdown(spark, d):
    return rounded(E.drawdown(_daily(spark, d), "day", "v"), "max_drawdown")


@query(f"WITH {DAYS} SELECT round(avg(v) / stddev_pop(v) * sqrt(252), 6) AS sharpe FROM daily")
def sharpe_ratio(spark, d):
    return rounded(_daily(spark, d).agg(M.sharpe("v").alias("sharpe")), "sharpe")


@query(f"""WITH {DAYS}, r AS (SELECT day, CASE WHEN row_number() OVER (ORDER BY day) >= 5 THEN stddev_pop(v) OVER (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS vol FROM daily), q AS (SELECT quantile_cont(vol, 1 / 3) AS a, quantile_cont(vol, 2 / 3) AS b FROM r)
SELECT CAST(day AS VARCHAR) AS day, CAST(CASE WHEN vol > a THEN 1 ELSE 0 END + CASE WHEN vol > b THEN 1 ELSE 0 END AS INT) AS regime FROM r, q""")
def fitted_regimes(spark, d):
    vol = E.rolling_std(_daily(spark, d), "day", "v", 5)
    return E.regimes(vol, E.regime_thresholds(vol, 3)).select(F.col("day").cast("string").alias("day"), "regime")


@query("WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM events), f AS (SELECT event_id, rn, n, k AS fold, k * (n // 5) AS a, least((k + 1) * (n // 5), n) AS b FROM n, range(5) t(k)), p AS (SELECT *, CASE WHEN rn >= a AND rn < b THEN 'test' WHEN rn < a OR rn >= b + CAST(floor(n * 0.01) AS BIGINT) THEN 'train' END AS part FROM f) SELECT CAST(event_id AS BIGINT) AS event_id, CAST(rn AS BIGINT) AS rn, CAST(fold AS INT) AS fold, part FROM p WHERE part IS NOT NULL")
def purged_folds(spark, d):
    return E.purged_folds(read(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 5, 0.01).select(F.col("event_id").cast("long").alias("event_id"), "rn", "fold", "part")


@query(f"""WITH {P}, r AS (SELECT row_id, row_number() OVER (ORDER BY abs(y) DESC, row_id) AS k, count(*) OVER () AS n FROM p), z AS (SELECT *, row_number() OVER (PARTITION BY k <= floor(n * 0.2) ORDER BY {boosted.mix_sql('row_id', 5)}, row_id) AS j FROM r)
SELECT row_id, round(CASE WHEN k <= floor(n * 0.2) THEN 1.0 ELSE (n - floor(n * 0.2)) / floor(n * 0.1) END, 6) AS weight FROM z WHERE k <= floor(n * 0.2) OR j <= floor(n * 0.1)""")
def goss(spark, d):
    return rounded(E.goss(orders(spark, d), "y", "row_id", seed=5).select("row_id", "weight"), "weight")


@query(f"""WITH {P}, m AS (SELECT *, abs(y) * exp(-0.001 * ((SELECT max(days) FROM p) - days)) AS key FROM p), r AS (SELECT *, row_number() OVER (ORDER BY key DESC, row_id) AS k, count(*) OVER () AS n FROM m),
z AS (SELECT *, row_number() OVER (PARTITION BY k <= floor(n * 0.2) ORDER BY -ln(({boosted.mix_sql('row_id', 5)} + 0.5) / 4294967296.0) / key, row_id) AS j FROM r)
SELECT row_id, round(CASE WHEN k <= floor(n * 0.2) THEN 1.0 ELSE 8.0 END, 6) AS weight FROM z WHERE k <= floor(n * 0.2) OR j <= floor(n * 0.1)""")
def weighted_goss(spark, d):
    return rounded(E.weighted_goss(orders(spark, d), "y", "row_id", "days", 0.001, seed=5).select("row_id", "weight"), "weight")


@query(f"SELECT CAST(o_orderkey AS BIGINT) AS row_id, CAST({boosted.mix_sql('CAST(o_orderkey AS BIGINT)', 3)} AS BIGINT) AS place, row_number() OVER (ORDER BY {boosted.mix_sql('CAST(o_orderkey AS BIGINT)', 3)}, o_orderkey) AS rank FROM orders")
def permutation(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("row_id"))
    return ordered.ranked(o.withColumn("place", ordered.mixed(o, "row_id", 3)), [], ["place", "row_id"], "rank")


@query("WITH c AS (SELECT count(DISTINCT o_orderpriority) AS a, count(DISTINCT o_custkey) AS b, count(DISTINCT o_orderstatus) AS c FROM orders) SELECT name FROM (SELECT unnest(['priority', 'cust', 'status']) AS name, unnest([a, b, c]) AS n FROM c) WHERE n <= 20")
def categorical(spark, d):
    o = read(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"), F.col("o_custkey").cast("double").alias("cust"), F.ascii("o_orderstatus").cast("double").alias("status"))
    return spark.createDataFrame([(c,) for c in categorical_columns(o, ["priority", "cust", "status"])], "name string")


@query(f"WITH {P} SELECT row_id, CASE WHEN isnan(v) THEN NULL ELSE v END AS v, CAST(event AS DOUBLE) AS event FROM (SELECT row_id, event, CASE WHEN row_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE y END AS v FROM p)")
def scanned_panel(spark, d):
    o = orders(spark, d).select("row_id", F.when(F.col("row_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("y")).alias("v"), "event")
    return panel(o, ["v"], "event")


@query(f"WITH {P}, c AS (SELECT cat, row_number() OVER (ORDER BY cat) - 1 AS k FROM (SELECT DISTINCT cat FROM p)) SELECT row_id, CAST(k AS BIGINT) AS k FROM p JOIN c USING (cat)")
def label_index(spark, d):
    o = orders(spark, d)
    classes = [r[0] for r in o.select("cat").distinct().orderBy("cat").collect()]
    return o.select("row_id", class_number(classes, "cat").cast("long").alias("k"))


BUNDLED = "z AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN x / 1000 ELSE 0 END AS a, CASE WHEN row_id % 3 = 1 THEN y / 1000 ELSE 0 END AS b, CAST(days AS DOUBLE) AS c FROM p)"


def _sparse(spark, d):
    o = orders(spark, d)
    return o.select("row_id", F.when(F.col("row_id") % 3 == 0, F.col("x") / 1000).otherwise(0.0).alias("a"), F.when(F.col("row_id") % 3 == 1, F.col("y") / 1000).otherwise(0.0).alias("b"), F.col("days").cast("double").alias("c"))


BUNDLE_EDGES = {"a": [50.0, 150.0, 250.0], "b": [0.0, 4.0], "c": [2000.0, 3000.0]}


@query(f"WITH {P}, {BUNDLED}, n AS (SELECT count(*) FILTER (a <> 0) AS a, count(*) FILTER (b <> 0) AS b, count(*) FILTER (c <> 0) AS c, count(*) FILTER (a <> 0 AND b <> 0) AS ab, count(*) FILTER (a <> 0 AND c <> 0) AS ac, count(*) FILTER (b <> 0 AND c <> 0) AS bc FROM z) SELECT CASE WHEN c >= a AND c >= b AND ac > 0 AND bc > 0 AND ab = 0 THEN 'c|' || CASE WHEN a >= b THEN 'a,b' ELSE 'b,a' END END AS bundles FROM n")
def bundle_search(spark, d):
    found = bundling.find_bundles(_sparse(spark, d), BUNDLE_EDGES)
    return spark.createDataFrame([("|".join(",".join(b) for b in found),)], "bundles string")


@query(f"WITH {P}, {BUNDLED} SELECT row_id, CAST(CASE WHEN b <> 0 THEN 5 + CAST(b >= 0 AS INT) + CAST(b >= 4 AS INT) WHEN a <> 0 THEN 1 + CAST(a >= 50 AS INT) + CAST(a >= 150 AS INT) + CAST(a >= 250 AS INT) ELSE 0 END AS INT) AS ab, CAST(CAST(c >= 2000 AS INT) + CAST(c >= 3000 AS INT) AS INT) AS c FROM z")
def bundle_merge(spark, d):
    bins = T.bin_column([F.col(f) for f in "abc"], [BUNDLE_EDGES[f] for f in "abc"], 255, [[0, 1], [2]])
    return _sparse(spark, d).select("row_id", bins.alias("bins")).select("row_id", F.col("bins")[0].cast("int").alias("ab"), F.col("bins")[1].cast("int").alias("c"))


@query(f"WITH {PRED} SELECT round(sqrt(avg((x - pred) * (x - pred))), 3) AS rmse, round(avg(abs(x - pred)), 3) AS mae, round(1 - sum((x - pred) * (x - pred)) / (var_pop(x) * count(*)), 6) AS r2, round(avg(CASE WHEN x >= pred THEN 0.9 * (x - pred) ELSE -0.1 * (x - pred) END), 3) AS pinball FROM v")
def metric_regression(spark, d):
    x, p = F.col("x"), F.col("pred")
    out = _predicted(spark, d).agg(M.rmse(x, p).alias("rmse"), M.mae(x, p).alias("mae"), M.r2(x, p).alias("r2"), M.pinball(x, p, 0.9).alias("pinball"))
    return rounded(rounded(out, "rmse", "mae", "pinball", digits=3), "r2")


def _labelled(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", F.col("quality").cast("double").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p"))


LAB = "j AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y, n_chars / (n_chars + 1000.0) AS p FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {LAB} SELECT round(-avg(y * ln(greatest(least(p, 1 - 1e-7), 1e-7)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-7), 1e-7))), 6) AS logloss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM j")
def metric_classification(spark, d):
    y, p = F.col("y"), F.col("p")
    return rounded(_labelled(spark, d).agg(M.logloss(y, p).alias("logloss"), M.accuracy(y, p).alias("accuracy")), "logloss", "accuracy")


@query(f"WITH {LAB} SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END), 6) AS auc FROM j a, j b WHERE a.y = 1 AND b.y = 0")
def metric_auc(spark, d):
    return rounded(M.auc(_labelled(spark, d), "y", "p", "doc_id"), "auc")


@query(f"""WITH {P}, k AS (SELECT cust, pow(2.0, CAST(substr(cat, 1, 1) AS INT)) - 1 AS g, row_number() OVER (PARTITION BY cust ORDER BY x DESC, row_id) AS i, row_number() OVER (PARTITION BY cust ORDER BY CAST(substr(cat, 1, 1) AS INT) DESC, row_id) AS j FROM p)
SELECT cust, round(sum(CASE WHEN i <= 5 THEN g / log2(i + 1) ELSE 0 END) / sum(CASE WHEN j <= 5 THEN g / log2(j + 1) ELSE 0 END), 6) AS ndcg FROM k GROUP BY cust""")
def metric_ndcg(spark, d):
    o = orders(spark, d).withColumn("rel", F.substring("cat", 1, 1).cast("int"))
    return rounded(M.ndcg(o, "cust", "rel", "x", "row_id", 5), "ndcg")


CIDX = "s AS (SELECT days AS t, event AS e, floor(y / 500) AS r FROM p)"


@query(f"WITH {P}, {CIDX}, c AS (SELECT t, e, r, count(*) AS n FROM s GROUP BY 1, 2, 3) SELECT round(sum(CASE WHEN a.r > b.r THEN 1.0 WHEN a.r = b.r THEN 0.5 ELSE 0.0 END * a.n * b.n) / sum(a.n * b.n), 6) AS c_index FROM c a JOIN c b ON b.t > a.t WHERE a.e = 1")
def metric_cindex(spark, d):
    return rounded(M.concordance(orders(spark, d).select("days", "event", F.floor(F.col("y") / 500).alias("r")), "days", "event", "r"), "c_index")


@query(f"""WITH {PRED}, k AS (SELECT row_id, y / 1000 AS t, x / 100000 AS s, event AS b FROM v), u AS (SELECT *, s - t AS e, 1 / (1 + exp(-s)) AS sg FROM k)
SELECT row_id, round(e, 9) AS g_mse, round(sign(e), 9) AS g_mae, round(greatest(least(e, 1), -1), 9) AS g_huber, round(CASE WHEN abs(e) <= 1 THEN 1 ELSE 1 / (abs(e) + 1e-8) END, 9) AS h_huber, round(CASE WHEN e <= 1 THEN e ELSE 2 END, 9) AS g_asymmetric_huber,
round(sg - b, 9) AS g_binary_logloss, round(greatest(sg * (1 - sg), 1e-7), 9) AS h_binary_logloss, round(CASE WHEN t < s THEN 0.5 ELSE -0.5 END, 9) AS g_quantile, round(-(1 - CASE WHEN t < s THEN 2.0 ELSE 0 END), 9) AS g_cvar FROM u""")
def grad_rowwise(spark, d):
    o = _predicted(spark, d).select("row_id", (F.col("y") / 1000).alias("t"), (F.col("x") / 100000).alias("s"), F.col("event").cast("double").alias("b"))
    out = []
    for name, make in O.ROWWISE.items():
        y, f = F.col("b" if name == "binary_logloss" else "t"), make()
        out.append(F.round(f.grad(y, F.col("s")), 9).alias(f"g_{name}"))
        if name in ("huber", "binary_logloss"):
            out.append(F.round(f.hess(y, F.col("s")), 9).alias(f"h_{name}"))
    return o.select("row_id", *out)


@query(f"""WITH {P}, s AS (SELECT row_id, days, CAST(event AS DOUBLE) AS e, exp(y / 5000) AS r FROM p), a AS (SELECT *, sum(r) OVER (ORDER BY days DESC RANGE UNBOUNDED PRECEDING) AS risk FROM s),
b AS (SELECT *, sum(e / risk) OVER (ORDER BY days RANGE UNBOUNDED PRECEDING) AS u, sum(e / (risk * risk)) OVER (ORDER BY days RANGE UNBOUNDED PRECEDING) AS v FROM a) SELECT row_id, round(r * u - e, 6) AS grad, round(greatest(r * u - r * r * v, 1e-7), 6) AS hess FROM b""")
def cox_gradient(spark, d):
    o = orders(spark, d).withColumn("f", F.col("y") / 5000)
    return rounded(O.cox_gradient(o, "days", "event", "f").select("row_id", "grad", "hess"), "grad", "hess")


@query(f"""WITH {P}, k AS (SELECT row_id, cust, CAST(substr(cat, 1, 1) AS INT) AS rel, x / 100000 AS s, pow(2.0, CAST(substr(cat, 1, 1) AS INT)) - 1 AS gain, 1 / log2(row_number() OVER (PARTITION BY cust ORDER BY x / 100000 DESC, row_id) + 1) AS disc,
 1 / log2(row_number() OVER (PARTITION BY cust ORDER BY CAST(substr(cat, 1, 1) AS INT) DESC, row_id) + 1) AS best FROM p), w AS (SELECT *, sum(gain * best) OVER (PARTITION BY cust) AS idcg FROM k),
z AS (SELECT a.row_id, CASE WHEN a.rel > b.rel THEN 1 ELSE -1 END AS u, a.s - b.s AS ds, abs((a.gain - b.gain) * (a.disc - b.disc)) / a.idcg AS dl FROM w a JOIN w b ON a.cust = b.cust AND a.rel <> b.rel),
y AS (SELECT row_id, -u / (1 + exp(u * ds)) * dl AS g FROM z), t AS (SELECT row_id, sum(g) AS grad FROM y GROUP BY 1) SELECT p.row_id, round(coalesce(grad, 0), 6) AS grad FROM p LEFT JOIN t ON t.row_id = p.row_id""")
def lambdarank_gradient(spark, d):
    o = orders(spark, d).withColumn("rel", F.substring("cat", 1, 1).cast("int")).withColumn("s", F.col("x") / 100000)
    return rounded(O.lambdarank(o, "row_id", "cust", "rel", "s").select("row_id", "grad"), "grad")


RANK = "2.0 * (row_number() OVER (ORDER BY y, row_id) - 1) / (count(*) OVER () - 1) - 1"


def _targets(spark, d):
    return W.rank_target(orders(spark, d), "y", "row_id").withColumn("f", F.col("x") / 100000).withColumn("dy", F.col("days").cast("double") / 1000)


@query(f"""WITH {P}, r AS (SELECT row_id, {RANK} AS t, x / 100000 AS f FROM p), m AS (SELECT avg(f) AS mp, stddev_pop(f) AS sp, stddev_pop(t) AS st, covar_pop(f, t) AS c FROM r)
SELECT row_id, round(f - t - 0.5 * c / (sp * st) * (f - mp) / (sp + 1e-9) / (st + 1e-9), 6) AS grad FROM r, m""")
def spearman_gradient(spark, d):
    return rounded(W.spearman_gradient(_targets(spark, d), "target", "f").select("row_id", "grad"), "grad")


@query(f"""WITH {RHO}, w AS (SELECT era, (pow(sd, 2) - mu * (rho - mu)) / (k * pow(sd, 3)) AS w, k FROM rho, (SELECT avg(rho) AS mu, stddev_pop(rho) + 1e-9 AS sd, count(*) AS k FROM rho)),
r AS (SELECT row_id, era, x / 100000 AS f, 2.0 * (row_number() OVER (PARTITION BY era ORDER BY y, row_id) - 1) / greatest(count(*) OVER (PARTITION BY era) - 1, 1) - 1 AS q FROM p),
m AS (SELECT era, count(*) AS n, avg(q) AS mr, stddev_pop(q) + 1e-9 AS sr, stddev_pop(f) + 1e-9 AS sp FROM r GROUP BY era)
SELECT row_id, round(CASE WHEN n < 2 THEN 0 ELSE -w * (q - mr) / (n * sp * sr) END, 6) AS grad, round(1.0 / (n * k), 9) AS hess FROM r JOIN m USING (era) JOIN w USING (era)""")
def max_sharpe_gradient(spark, d):
    o = orders(spark, d).withColumn("f", F.col("x") / 100000)
    return W.max_sharpe_gradient(o, "era", "y", "f", "row_id").select("row_id", F.round("grad", 6).alias("grad"), F.round("hess", 9).alias("hess"))


@query(f"""WITH {P}, r AS (SELECT row_id, {RANK} AS t, x / 100000 AS f, days / 1000.0 AS a FROM p), b AS (SELECT sum(a * f) / (sum(a * a) + 1e-4) AS b FROM r), o AS (SELECT row_id, a, f - b * a - t AS off FROM r, b), c AS (SELECT sum(a * off) / (sum(a * a) + 1e-4) AS c FROM o)
SELECT row_id, round(off - c * a, 6) AS grad FROM o, c""")
def neutral_gradient(spark, d):
    return rounded(W.neutral_gradient(_targets(spark, d), "target", "f", ["dy"]).select("row_id", "grad"), "grad")


@query(f"WITH {P} SELECT row_id, round(0.7 * (x / 100000 - y / 1000) + 0.3 * ((x / 100000 - days / 1000.0) + (x / 100000 - event)) / 2, 9) AS grad FROM p")
def multi_target_gradient(spark, d):
    o = orders(spark, d).withColumn("s", F.col("x") / 100000)
    grad, _ = W.multi_target(O.mse(), F.col("y") / 1000, F.col("s"), [F.col("days") / 1000.0, F.col("event").cast("double")], 0.7)
    return o.select("row_id", F.round(grad, 9).alias("grad"))


@query(f"""WITH {P}, s AS (SELECT row_id, [x / 100000, y / 1000, days / 1000.0] AS z, CAST(substr(cat, 1, 1) AS INT) % 3 AS k FROM p), e AS (SELECT row_id, k, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM s), q AS (SELECT row_id, k, list_transform(e, lambda v: v / list_sum(e)) AS q FROM e)
SELECT row_id, round(q[1] - CASE WHEN k = 0 THEN 1 ELSE 0 END, 6) AS g0, round(q[2] - CASE WHEN k = 1 THEN 1 ELSE 0 END, 6) AS g1, round(q[3] - CASE WHEN k = 2 THEN 1 ELSE 0 END, 6) AS g2, round(greatest(q[1] * (1 - q[1]), 1e-7), 6) AS h0 FROM q""")
def softmax_gradient(spark, d):
    o = orders(spark, d)
    g, h = O.softmax_gradient(F.substring("cat", 1, 1).cast("int") % 3, F.array(F.col("x") / 100000, F.col("y") / 1000, F.col("days") / 1000.0))
    return o.select("row_id", *[F.round(g[k], 6).alias(f"g{k}") for k in range(3)], F.round(h[0], 6).alias("h0"))


@query(f"WITH {P} SELECT cat, round(ln(count(*) / CAST((SELECT count(*) FROM p) AS DOUBLE)), 9) AS init FROM p GROUP BY cat")
def log_priors(spark, d):
    return rounded(O.log_priors(orders(spark, d), "cat"), "init", digits=9)


@query(f"WITH {P} SELECT round(avg(y), 6) AS mean, round(median(y), 6) AS median, round(quantile_cont(y, 0.8), 6) AS quantile, round(ln(avg(event) / (1 - avg(event))), 6) AS log_odds FROM p")
def init_scores(spark, d):
    made = {"mean": (O.mse(), "y"), "median": (O.mae(), "y"), "quantile": (O.quantile(0.8), "y"), "log_odds": (O.logloss(), "event")}
    return orders(spark, d).agg(*[F.round(o.init(F.col(c).cast("double")), 6).alias(n) for n, (o, c) in made.items()])


@query()
def multiclass_embeddings(spark, d):
    e = read(spark, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"e{i}" for i in range(width)]
    rows = e.select(F.col("vec_id").alias("row_id"), F.col("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    model = Classifier(features=names, n_estimators=3, max_depth=2, max_bins=16).fit(rows)
    return model.transform(rows).select("row_id", F.col("prediction").cast("int").alias("prediction"))


def queries():
    return {**Q, **boosted.queries()}


def oracle_sql():
    return {**S, **boosted.oracle_sql()}
