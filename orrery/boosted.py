"""Queries that fit models by the boosting loop, and the same models in SQL.

The SQL of a model is written round by round and level by level: gradients, histograms, the best split of each node by
window functions, children, leaf values, scores.  It shares nothing with the loop but the parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from .estimators import BinaryClassifier, MultiTargetRegressor, QuantileRegressor, Ranker, RankRegressor, Regressor, Survival
from .functions import frame_objectives as W
from .functions import objectives as O
from .plans.boosting import drop_set

#: Cuts of the features of `panel`, so that both engines bin alike.
EDGES = {"x": [60_000.0, 110_000.0, 160_000.0, 210_000.0, 300_000.0], "days": [1800.0, 2400.0, 3000.0, 3600.0], "priority": [1.5, 2.5, 3.5, 4.5]}
SOURCE = """p AS (SELECT CAST(o_orderkey AS BIGINT) AS row_id, strftime(o_orderdate, '%Y-%m') AS era, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS x,
 CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS days, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
 c_acctbal / 1000 AS y, CAST(o_custkey AS BIGINT) AS cust, CASE WHEN c_acctbal > 4000 THEN 1.0 ELSE 0.0 END AS rich, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS died FROM orders JOIN customer ON o_custkey = c_custkey)"""


def panel(spark, d):
    from .queries import orders

    o = orders(spark, d)
    return o.select("row_id", "era", F.when(F.col("row_id") % 11 != 0, F.col("x")).alias("x"), F.col("days").cast("double").alias("days"), F.substring("cat", 1, 1).cast("double").alias("priority"), (F.col("y") / 1000).alias("y"), "cust", F.when(F.col("y") > 4000, 1.0).otherwise(0.0).alias("rich"), F.col("event").cast("double").alias("died"))


@dataclass
class Plan:
    """What the SQL of a model needs: expressions over label t, score s and the columns of the round's rows."""

    label: str = "y"
    init: str = "avg(t)"
    grad: str = "s - t"
    hess: str = "1.0"
    leaf: str = "CASE WHEN abs(sum(g)) <= {alpha} THEN 0 ELSE -(sum(g) - sign(sum(g)) * {alpha}) / (sum(h) + {lam}) END"
    link: str = "s"
    rounds: int = 2
    depth: int = 2
    rate: float = 0.5
    lam: float = 1.0
    alpha: float = 0.0
    weight: float = 1.0  # least hessian of a child
    growth: str = "depthwise"
    max_leaves: int = 31
    changes: list[str] = field(default_factory=list)  # each: SELECT of the round's rows from {rows}, with new g, h
    child: str = "{lam}"  # regularization of a child of {n} rows in round {r}
    penalty: float = 0.0
    monotone: dict[int, int] = field(default_factory=dict)
    drops: list[list[int]] = field(default_factory=list)


def model_sql(m: Plan) -> str:
    """(row_id, prediction) of the model."""
    features, parts = list(EDGES), [SOURCE]
    bins = [f"CASE WHEN {f} IS NULL THEN 255 ELSE {' + '.join(f'CAST({f} >= {e} AS INT)' for e in EDGES[f])} END AS b{k}" for k, f in enumerate(features)]
    parts.append(f"base AS MATERIALIZED (SELECT *, {m.label} AS t, {', '.join(bins)} FROM p)")
    parts.append(f"st0 AS MATERIALIZED (SELECT base.*, (SELECT {m.init} FROM base) AS s FROM base)")
    rates: list[float] = []
    for r in range(m.rounds):
        dropped = m.drops[r] if m.drops else []
        rows = f"st{r}"
        if dropped:
            minus = " + ".join(f"{rates[k]!r} * v{k}" for k in dropped)
            parts.append(f"dr{r} AS MATERIALIZED (SELECT * REPLACE (s - ({minus}) AS s) FROM {rows})")
            rows = f"dr{r}"
        parts.append(f"gr{r} AS MATERIALIZED (SELECT *, CAST({m.grad} AS DOUBLE) AS g, CAST({m.hess} AS DOUBLE) AS h FROM {rows})")
        rows = f"gr{r}"
        for k, change in enumerate(m.changes):
            parts.append(f"ch{r}_{k} AS MATERIALIZED ({change.format(rows=rows, r=r)})")
            rows = f"ch{r}_{k}"
        parts.append(f"lv{r}_0 AS MATERIALIZED (SELECT row_id, 0 AS node, {', '.join(f'b{k}' for k in range(len(features)))}, era, t, s, g, h FROM {rows})")
        splits: list[str] = []
        for depth in range(m.depth):
            parts += _level(m, r, depth, len(features), splits)
        values = f"vl{r}"
        leaf = m.leaf.format(lam=m.lam, alpha=m.alpha)
        parts.append(f"{values} AS MATERIALIZED (SELECT node, {leaf} AS v FROM lv{r}_{m.depth} GROUP BY node)")
        parts += _routed(r, m.depth, len(features))
        k = len(dropped)
        rates.append(m.rate / (1 + k))
        step = f"{rates[-1]!r} * v"
        for i in dropped:
            step += f" - {rates[i]!r} / {1 + k} * v{i}"
            rates[i] *= k / (1 + k)
        parts.append(f"st{r + 1} AS MATERIALIZED (SELECT a.* REPLACE (s + {step} AS s), v AS v{r} FROM st{r} a JOIN rt{r}_{m.depth} n ON n.row_id = a.row_id JOIN {values} l ON l.node = n.node)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT row_id, round({m.link}, 6) AS prediction FROM st{m.rounds}"


def _level(m: Plan, r: int, depth: int, width: int, splits: list[str]) -> list[str]:
    at, lam = f"{r}_{depth}", m.lam
    every = f"unnest([{', '.join(map(str, range(width)))}]) AS f, unnest([{', '.join(f'b{k}' for k in range(width))}]) AS b"
    cells = f"ce{at} AS MATERIALIZED (SELECT node, f, b, sum(g) AS g, sum(h) AS h, count(*) AS c FROM (SELECT node, g, h, {every} FROM lv{at}) GROUP BY 1, 2, 3)"
    sums = ", ".join(f"coalesce(sum({x}) FILTER (b < 255) OVER w, 0) AS {x}l, sum({x}) OVER v AS {x}t, coalesce(sum({x}) FILTER (b = 255) OVER v, 0) AS {x}n" for x in "ghc")
    run = f"ru{at} AS MATERIALIZED (SELECT node, f, b, {sums} FROM ce{at} WINDOW w AS (PARTITION BY node, f ORDER BY b ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY node, f))"
    sides = f"sd{at} AS (SELECT node, f, b, d, gl + CASE WHEN d = 0 THEN gn ELSE 0 END AS gl, hl + CASE WHEN d = 0 THEN hn ELSE 0 END AS hl, cl + CASE WHEN d = 0 THEN cn ELSE 0 END AS cl, gt, ht, ct FROM ru{at}, (VALUES (0), (1)) x(d) WHERE b < 255)"
    score = lambda g, h, l: f"pow(greatest(abs({g}) - {m.alpha}, 0), 2) / ({h} + {l})"
    child = lambda n: m.child.format(lam=lam, n=n, r=r)
    gain = f"0.5 * ({score('gl', 'hl', child('cl'))} + {score('(gt - gl)', '(ht - hl)', child('(ct - cl)'))} - {score('gt', 'ht', lam)})"
    allowed = f"hl >= {m.weight} AND ht - hl >= {m.weight} AND cl >= 1 AND ct - cl >= 1"
    for f, sign in m.monotone.items():
        allowed += f" AND (f <> {f} OR {sign} * (-(gt - gl) / (ht - hl + {lam}) + gl / (hl + {lam})) >= 0)"
    out = [cells, run, sides]
    if m.penalty:
        out += _penalty_sql(m, at, every)
        out.append(f"ga{at} AS MATERIALIZED (SELECT a.node, a.f, a.b, a.d, {gain} - {m.penalty} * penalty AS gain, gl, hl, cl FROM sd{at} a JOIN pe{at} e ON e.node = a.node AND e.f = a.f AND e.b = a.b AND e.d = a.d WHERE {allowed})")
    else:
        out.append(f"ga{at} AS MATERIALIZED (SELECT node, f, b, d, {gain} AS gain, gl, hl, cl FROM sd{at} WHERE {allowed})")
    order = "ORDER BY round(gain, 7) DESC, f, d, b"
    if m.growth == "symmetric":
        out.append(f"sm{at} AS MATERIALIZED (SELECT f, b, d, sum(gain) AS total FROM ga{at} GROUP BY 1, 2, 3 ORDER BY round(total, 7) DESC, f, d, b LIMIT 1)")
        out.append(f"be{at} AS MATERIALIZED (SELECT a.node, a.f, a.b, a.d, a.gain FROM ga{at} a JOIN sm{at} o ON o.f = a.f AND o.b = a.b AND o.d = a.d WHERE o.total > 1e-12)")
    else:
        keep = ""
        if m.growth in ("leafwise", "hybrid") and depth == 1:  # of the second level only as many splits as leaves are left, by gain
            keep = f" QUALIFY row_number() OVER (ORDER BY gain DESC, node) <= {m.max_leaves - 2}"
        out.append(f"be{at} AS MATERIALIZED (SELECT * FROM (SELECT node, f, b, d, gain FROM ga{at} WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY node {order}) = 1){keep})")
    bins = f"CASE f {' '.join(f'WHEN {k} THEN b{k}' for k in range(width))} END"
    down = f"CASE WHEN n.f IS NULL THEN a.node WHEN (CASE WHEN {bins} = 255 THEN n.d = 0 ELSE {bins} <= n.b END) THEN 2 * a.node + 1 ELSE 2 * a.node + 2 END"
    out.append(f"lv{r}_{depth + 1} AS MATERIALIZED (SELECT a.* REPLACE ({down} AS node) FROM lv{at} a LEFT JOIN be{at} n ON n.node = a.node)")
    return out


def _routed(r: int, depth: int, width: int) -> list[str]:
    """All rows of the round, sampled or not, at their leaves."""
    out = [f"rt{r}_0 AS MATERIALIZED (SELECT row_id, 0 AS node, {', '.join(f'b{k}' for k in range(width))} FROM st{r})"]
    bins = f"CASE f {' '.join(f'WHEN {k} THEN b{k}' for k in range(width))} END"
    down = f"CASE WHEN n.f IS NULL THEN a.node WHEN (CASE WHEN {bins} = 255 THEN n.d = 0 ELSE {bins} <= n.b END) THEN 2 * a.node + 1 ELSE 2 * a.node + 2 END"
    for k in range(depth):
        out.append(f"rt{r}_{k + 1} AS MATERIALIZED (SELECT a.* REPLACE ({down} AS node) FROM rt{r}_{k} a LEFT JOIN be{r}_{k} n ON n.node = a.node)")
    return out


def _penalty_sql(m: Plan, at: str, every: str) -> list[str]:
    value = lambda g, h: f"CASE WHEN {h} > 1e-6 THEN -({g}) / ({h} + {m.lam}) END"
    sums = ", ".join(f"coalesce(sum({x}) FILTER (b < 255) OVER w, 0) AS {x}l, sum({x}) OVER v AS {x}t, coalesce(sum({x}) FILTER (b = 255) OVER v, 0) AS {x}n" for x in "gh")
    return [
        f"eh{at} AS MATERIALIZED (SELECT node, era, f, b, sum(g) AS g, sum(h) AS h FROM (SELECT node, era, g, h, {every} FROM lv{at}) GROUP BY 1, 2, 3, 4)",
        f"ef{at} AS MATERIALIZED (SELECT c.node, e.era, c.f, c.b, coalesce(x.g, 0) AS g, coalesce(x.h, 0) AS h FROM (SELECT DISTINCT node, f, b FROM eh{at}) c CROSS JOIN (SELECT DISTINCT era FROM eh{at}) e LEFT JOIN eh{at} x ON x.node = c.node AND x.era = e.era AND x.f = c.f AND x.b = c.b)",
        f"er{at} AS MATERIALIZED (SELECT node, era, f, b, {sums} FROM ef{at} WINDOW w AS (PARTITION BY node, era, f ORDER BY b ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY node, era, f))",
        f"es{at} AS (SELECT node, f, b, d, gl + CASE WHEN d = 0 THEN gn ELSE 0 END AS gl, hl + CASE WHEN d = 0 THEN hn ELSE 0 END AS hl, gt, ht FROM er{at}, (VALUES (0), (1)) x(d) WHERE b < 255)",
        f"pe{at} AS MATERIALIZED (SELECT node, f, b, d, coalesce(var_pop({value('gl', 'hl')}), 0) + coalesce(var_pop({value('gt - gl', 'ht - hl')}), 0) AS penalty FROM es{at} GROUP BY 1, 2, 3, 4)",
    ]


#: The row hash of operators/ordered.py in SQL.
def mix_sql(row: str, seed: int) -> str:
    low = (1 << 32) - 1
    x = f"xor(xor({row}, {row} >> 32) & {low}, {(seed * 2654435761 + 12345) & low})"
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * {0x45D9F3B}) & {low})"
    return f"xor({x}, {x} >> 16)"


RANKED = "CAST(row_number() OVER (PARTITION BY era ORDER BY {x}, row_id) AS DOUBLE)"
ERA_WEIGHTS = """WITH k AS (SELECT *, CAST(row_number() OVER (PARTITION BY era ORDER BY s, row_id) AS DOUBLE) AS rx, CAST(row_number() OVER (PARTITION BY era ORDER BY t, row_id) AS DOUBLE) AS ry FROM {rows}),
 e AS (SELECT era, count(*) AS n, CASE WHEN stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) ELSE 0 END AS rho FROM k GROUP BY era),
 w AS (SELECT era, n, greatest(exp(-rho) / sum(exp(-rho)) OVER (), 0.5 / count(*) OVER ()) AS w, sum(n) OVER () AS total FROM e), z AS (SELECT era, w / sum(w) OVER () * total / n AS rw FROM w)
 SELECT a.* REPLACE (g * rw AS g, h * rw AS h) FROM {rows} a JOIN z USING (era)"""
MAD = """WITH m AS (SELECT era, median(g) AS m, count(*) AS n FROM {rows} GROUP BY era), d AS (SELECT era, median(abs(g - m)) AS mad, any_value(n) AS n FROM {rows} JOIN m USING (era) GROUP BY era)
 SELECT a.* REPLACE (CASE WHEN n < 2 THEN g ELSE sign(g) * least(abs(g), mad * 1.5) END AS g) FROM {rows} a JOIN d USING (era)"""
EXPOSURE = "WITH c AS (SELECT avg(s) AS mp, stddev_pop(s) + 1e-9 AS sp, " + ", ".join(f"avg({f}) AS m{k}, stddev_pop({f}) + 1e-9 AS s{k}, covar_pop(s, {f}) AS c{k}" for k, f in enumerate(EDGES)) + " FROM {rows}) SELECT a.* REPLACE (g + 0.3 * (" + " + ".join(f"2 * (c{k} / (sp * s{k})) * ((coalesce({f}, m{k}) - m{k}) / s{k} - c{k} / (sp * s{k}) * (s - mp) / sp)" for k, f in enumerate(EDGES)) + ") AS g) FROM {rows} a, c"
ORTHOGONAL = """WITH q AS (SELECT sum(priority * priority) + 1e-4 AS a, sum(priority * days) AS b, sum(days * days) + 1e-4 AS c, sum(priority * g) AS u, sum(days * g) AS v FROM {rows})
 SELECT a.* REPLACE (g - 0.8 * ((c * u - b * v) / (q.a * c - b * b) * priority + (q.a * v - b * u) / (q.a * c - b * b) * days) AS g) FROM {rows} a, q"""
TEMPORAL = "SELECT * REPLACE (g + 0.1 * (2 * s - coalesce(lag(s) OVER w, s) - coalesce(lead(s) OVER w, s)) AS g) FROM {rows} WINDOW w AS (PARTITION BY era ORDER BY row_id)"


def _sampled(key: str, draw: str, weight: str, seed: int) -> str:
    return f"""WITH k AS (SELECT *, row_number() OVER (ORDER BY {key} DESC, row_id) AS k, count(*) OVER () AS n FROM {{rows}}), z AS (SELECT *, row_number() OVER (PARTITION BY k <= greatest(1, floor(n * 0.2)) ORDER BY {draw}, row_id) AS j FROM k)
 SELECT * EXCLUDE (k, n, j) REPLACE (g * w AS g, h * w AS h) FROM (SELECT *, CASE WHEN k <= greatest(1, floor(n * 0.2)) THEN 1.0 WHEN j <= greatest(1, floor(n * 0.1)) THEN {weight} END AS w FROM z) WHERE w IS NOT NULL""".replace("* EXCLUDE (k, n, j)", "* EXCLUDE (k, n, j, w)")


SIGMOID = "1 / (1 + exp(-s))"
BASE = dict(features=list(EDGES), label="y", n_estimators=2, learning_rate=0.5, max_depth=2, growth="depthwise", edges=EDGES)
COX = """WITH a AS (SELECT *, sum(exp(s)) OVER (ORDER BY t DESC RANGE UNBOUNDED PRECEDING) AS risk FROM {rows}), b AS (SELECT *, sum(died / risk) OVER (ORDER BY t RANGE UNBOUNDED PRECEDING) AS u, sum(died / (risk * risk)) OVER (ORDER BY t RANGE UNBOUNDED PRECEDING) AS v FROM a)
 SELECT * EXCLUDE (risk, u, v) REPLACE (exp(s) * u - died AS g, greatest(exp(s) * u - exp(2 * s) * v, 1e-7) AS h) FROM b"""
LAMBDA = """WITH k AS (SELECT *, pow(2.0, t) - 1 AS gain, 1 / log2(row_number() OVER (PARTITION BY cust ORDER BY s DESC, row_id) + 1) AS disc, 1 / log2(row_number() OVER (PARTITION BY cust ORDER BY t DESC, row_id) + 1) AS best FROM {rows}),
 w AS (SELECT *, sum(gain * best) OVER (PARTITION BY cust) AS idcg FROM k),
 z AS (SELECT a.row_id, CASE WHEN a.t > b.t THEN 1 ELSE -1 END AS u, a.s - b.s AS ds, abs((a.gain - b.gain) * (a.disc - b.disc)) / a.idcg AS dl FROM w a JOIN w b ON a.cust = b.cust AND a.t <> b.t WHERE a.idcg > 0),
 y AS (SELECT row_id, sum(-u / (1 + exp(u * ds)) * dl) AS gg, sum(1 / (1 + exp(u * ds)) * (1 - 1 / (1 + exp(u * ds))) * dl) AS hh FROM z GROUP BY 1)
 SELECT a.* REPLACE (coalesce(gg, 0) AS g, CASE WHEN hh IS NULL THEN 1 ELSE greatest(hh, 1e-7) END AS h) FROM {rows} a LEFT JOIN y ON y.row_id = a.row_id"""
RANK_LABEL = "2.0 * (row_number() OVER (ORDER BY y, row_id) - 1) / (count(*) OVER () - 1) - 1"
SPEARMAN = """WITH m AS (SELECT avg(s) AS mp, stddev_pop(s) AS sp, stddev_pop(t) AS st, covar_pop(s, t) AS c FROM {rows})
 SELECT a.* REPLACE (s - t - CASE WHEN sp > 1e-9 THEN 0.5 * (c / (sp * st)) * (s - mp) / (sp + 1e-9) / (st + 1e-9) ELSE 0 END AS g) FROM {rows} a, m"""


def _fit(model, **args):
    return lambda spark, d: _predict(model, spark, d, args)


def _predict(model, spark, d, args):
    df = panel(spark, d)
    return model(**BASE | args).fit(df).transform(df).select("row_id", F.round("prediction", 6).alias("prediction"))


def _drops(rounds: int, **args) -> list[list[int]]:
    p = Regressor(**BASE | args).params
    return [drop_set(p, t, t, []) for t in range(rounds)]


DART = dict(dart=True, drop_rate=0.6, n_estimators=4, seed=3, max_depth=1)

#: Name to (query, plan of its SQL).
MODELS = {
    "boosted_depthwise": (_fit(Regressor), Plan()),
    "boosted_by_levels": (_fit(Regressor, task_cells=0), Plan()),
    "boosted_leafwise": (_fit(Regressor, growth="leafwise", max_leaves=3), Plan(growth="leafwise", max_leaves=3)),
    "boosted_symmetric": (_fit(Regressor, growth="symmetric"), Plan(growth="symmetric")),
    "boosted_hybrid": (_fit(Regressor, growth="hybrid", symmetric_depth=1, max_leaves=3), Plan(growth="hybrid", max_leaves=3)),
    "boosted_deep": (_fit(Regressor, max_depth=3, n_estimators=3, reg_alpha=2.0, reg_lambda=3.0, min_child_weight=40.0, task_cells=0), Plan(depth=3, rounds=3, alpha=2.0, lam=3.0, weight=40.0)),
    "boosted_binary": (_fit(BinaryClassifier, label="rich"), Plan(label="rich", init="ln(avg(t) / (1 - avg(t)))", grad=f"{SIGMOID} - t", hess=f"greatest({SIGMOID} * (1 - {SIGMOID}), 1e-7)", link=SIGMOID)),
    "boosted_mae": (_fit(Regressor, objective="mae"), Plan(init="median(t)", grad="sign(s - t)", leaf="median(t - s)")),
    "boosted_huber": (_fit(Regressor, objective="huber"), Plan(init="median(t)", grad="greatest(least(s - t, 1), -1)", hess="CASE WHEN abs(s - t) <= 1 THEN 1 ELSE 1 / (abs(s - t) + 1e-8) END", leaf="avg(t - s)")),
    "boosted_asymmetric": (_fit(Regressor, objective="asymmetric_huber"), Plan(grad="CASE WHEN s - t <= 1 THEN s - t ELSE 2 END", hess="CASE WHEN s - t <= 1 THEN 1 ELSE 1e-3 END")),
    "boosted_quantile": (_fit(QuantileRegressor, objective_options={"alpha": 0.8}), Plan(init="quantile_cont(t, 0.8)", grad="CASE WHEN t < s THEN 0.2 ELSE -0.8 END", leaf="quantile_cont(t - s, 0.8)")),
    "boosted_cvar": (_fit(QuantileRegressor, objective="cvar", objective_options={"alpha": 0.8}), Plan(init="quantile_cont(t, 0.8)", grad="-(1 - CASE WHEN t < s THEN 1.25 ELSE 0 END)")),
    "boosted_era_weights": (_fit(Regressor, era="era", era_method="hard_era", era_floor=0.5), Plan(changes=[ERA_WEIGHTS])),
    "boosted_era_penalty": (_fit(Regressor, era="era", era_beta=3.0), Plan(penalty=3.0)),
    "boosted_era_clip": (_fit(Regressor, era="era", era_clip=1.5), Plan(changes=[MAD])),
    "boosted_exposure": (_fit(Regressor, exposure_lambda=0.3), Plan(changes=[EXPOSURE])),
    "boosted_exposed_objective": (_fit(Regressor, objective=W.exposed(O.mse(), 3, 0.3)), Plan(changes=[EXPOSURE])),
    "boosted_orthogonal": (_fit(Regressor, orthogonal=["priority", "days"], orthogonal_strength=0.8), Plan(changes=[ORTHOGONAL])),
    "boosted_temporal": (_fit(Regressor, era="era", temporal_rho=0.05), Plan(changes=[TEMPORAL])),
    "boosted_clipped": (_fit(Regressor, clip_tau=2.0), Plan(changes=["SELECT * REPLACE (greatest(least(g, 2.0), -2.0) AS g) FROM {rows}"])),
    "boosted_adaptive": (_fit(Regressor, adaptive=True), Plan(child="({lam} * (1 + 0.5 * {r} / 2.0) + 1.0 / sqrt({n}))")),
    "boosted_monotone": (_fit(Regressor, monotone={1: 1}, max_depth=1, n_estimators=3), Plan(monotone={1: 1}, depth=1, rounds=3)),
    "boosted_subsample": (_fit(Regressor, subsample=0.5, n_estimators=1), Plan(rounds=1, changes=[f"SELECT * FROM {{rows}} WHERE {mix_sql('row_id', 0)} < {1 << 31}"])),
    "boosted_goss": (_fit(Regressor, goss=True, n_estimators=1), Plan(rounds=1, changes=[_sampled("abs(g)", mix_sql("row_id", 0), "(n - greatest(1, floor(n * 0.2))) / greatest(1, floor(n * 0.1))", 0)])),
    "boosted_weighted_goss": (_fit(Regressor, era="era", order="days", time_decay=0.001, n_estimators=1), Plan(rounds=1, changes=[_sampled("abs(g) * exp(-0.001 * ((SELECT max(days) FROM {rows}) - days))", f"-(ln(({mix_sql('row_id', 0)} + 0.5) / 4294967296.0) / nullif(abs(g) * exp(-0.001 * ((SELECT max(days) FROM {{rows}}) - days)), 0))", "(1 - 0.2) / 0.1", 0)])),
    "boosted_dart": (_fit(Regressor, **DART), Plan(rounds=4, depth=1, drops=_drops(4, **DART))),
    "boosted_ordered": (_fit(Regressor, ordered=True), Plan()),
    "boosted_survival": (_fit(Survival, label="days", event="died", features=["x", "days", "priority"], learning_rate=0.1), Plan(label="days", init="max(0.0)", grad="0", hess="1", rate=0.1, link="exp(s)", changes=[COX])),
    "boosted_ranker": (_fit(Ranker, label="priority", group="cust", features=["x", "days", "priority"]), Plan(label="priority", init="max(0.0)", grad="0", hess="1", changes=[LAMBDA])),
    "boosted_rank_target": (_fit(RankRegressor), Plan(label=RANK_LABEL, changes=[SPEARMAN])),
    "boosted_multi_target": (_fit(MultiTargetRegressor, aux=["rich", "died"], alpha=0.8, alpha_start=0.2), Plan(grad="{share} * (s - t) + (1 - {share}) * ((s - rich) + (s - died)) / 2")),
}


def queries():
    return {name: f for name, (f, _) in MODELS.items()}


def oracle_sql():
    out = {}
    for name, (_, plan) in MODELS.items():
        if "{share}" in plan.grad:  # 0.2 in the first of two rounds, 0.8 in the last
            plan = Plan(**vars(plan) | {"grad": plan.grad.replace("{share}", "@")})
            out[name] = _scheduled(plan, ["0.2", "0.8"])
        else:
            out[name] = model_sql(plan)
    return out


def _scheduled(plan: Plan, shares: list[str]) -> str:
    sql = model_sql(plan)
    for r, share in enumerate(shares):
        head = f"gr{r} AS MATERIALIZED ("
        at = sql.index(head)
        end = sql.index(" AS g,", at)
        sql = sql[:at] + sql[at:end].replace("@", share) + sql[end:]
    return sql
