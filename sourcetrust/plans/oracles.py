"""SQL twins of the queries, for DuckDB on the same tables.

Each statement is a chain of named common table expressions. Randomness is the same md5 of
seed and key; floating-point output is rounded as in the queries.
"""

from __future__ import annotations

import re

from sourcetrust.plans.rounding import nudge

FEATURES = ["quantity", "extendedprice", "discount", "tax"]
TIER = (
    "CASE WHEN {m} < 3 THEN 'high' WHEN {m} < 6 THEN 'medium' WHEN {m} < 9 THEN 'low' ELSE 'compromised' END"
)
NOISE = {"high": (0.0, 0.0), "medium": (0.25, 0.15), "low": (0.55, 0.35), "compromised": (0.99, 0.95)}


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def rnd(x: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({dbl(x)} + {nudge(digits)!r}, {digits}) + 0.0 AS {name or x}"


def key(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def hex_uniform(hex_: str, at: int = 1) -> str:
    return f"(CAST('0x' || substr({hex_}, {at}, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def uniform(*parts: str) -> str:
    return hex_uniform(key(*parts))


def normal(hex_: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {hex_uniform(hex_, 9)})) * cos(2.0::DOUBLE * pi() * {hex_uniform(hex_, 17)}))"


def with_(*ctes: str, final: str, recursive: bool = False) -> str:
    """A statement of steps; each is computed once, where none is recursive."""
    if not recursive:
        ctes = tuple(re.sub(r"(^|,\n)(\w+) AS \(", r"\1\2 AS MATERIALIZED (", cte) for cte in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + final


FLOWS = """flows AS (SELECT 'client_' || (l_suppkey % 12) AS client_id,
  concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS row_id,
  l_suppkey AS supplier, l_shipdate AS ts, CAST(year(l_shipdate) - 1994 AS BIGINT) AS round,
  CASE WHEN l_returnflag = 'N' THEN 'BENIGN' ELSE 'ATTACK_' || l_returnflag END AS label_raw,
  CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS label,
  l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax,
  """ + TIER.format(m="l_suppkey % 12") + " AS quality FROM lineitem)"

NAMED = f"""named AS (SELECT *, CASE
  WHEN supplier % 16 < 9 THEN 'client_' || (supplier % 16 + 1) || '_' || {TIER.format(m='supplier % 16')} || '_quality_mixed_s' || (supplier % 16) || '.csv'
  WHEN supplier % 16 < 12 THEN 'client_' || (supplier % 16 + 1) || '_compromised_mixed_s' || (supplier % 16) || '.csv'
  WHEN supplier % 16 = 12 THEN 'mixed_s12.csv' WHEN supplier % 16 = 13 THEN 's13.csv'
  WHEN supplier % 16 = 14 THEN 'prepared_test_set.csv' ELSE 'Benign_s15.csv' END AS source_name FROM flows)"""

KINDS = """kinds AS (SELECT *, CASE WHEN lower(source_name) LIKE '%benign%' THEN NULL
  WHEN lower(source_name) LIKE '%test\\_set%' ESCAPE '\\' THEN NULL
  WHEN regexp_matches(lower(source_name), 'high_quality|medium_quality|low_quality|compromised') THEN 1
  WHEN source_name LIKE 'mixed\\_%' ESCAPE '\\' THEN 2 ELSE 3 END AS priority FROM named)"""
PREFERRED = "preferred AS (SELECT * FROM kinds WHERE priority = (SELECT min(priority) FROM kinds))"

BROKEN = """broken AS (SELECT client_id, row_id, discount,
  CASE WHEN tax = 0 THEN 'NaN'::DOUBLE ELSE quantity END AS quantity,
  CASE WHEN discount = 0 THEN 'Infinity'::DOUBLE WHEN quantity > 45 THEN '-Infinity'::DOUBLE ELSE extendedprice * 20 END AS extendedprice,
  CASE WHEN quantity > 25 THEN tax END AS tax FROM flows)"""


def finite(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0::DOUBLE ELSE {x} END"


CLEANED = "cleaned AS (SELECT client_id, row_id, " + ", ".join(
    f"least(greatest({finite(f)}, -1e6::DOUBLE), 1e6::DOUBLE) AS {f}" for f in FEATURES
) + " FROM broken)"


def shares(source: str, total: str, name: str = "quotas", keys: str = "client_id") -> str:
    """Largest-remainder quotas; `source` has keys, label, n and what `total` needs."""
    return f"""{name}_a AS (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS ns FROM {source}),
{name}_b AS (SELECT *, CAST({total} AS HUGEINT) AS total FROM {name}_a),
{name}_c AS (SELECT *, (total * n) // ns AS fl, (total * n) % ns AS rest FROM {name}_b),
{name} AS (SELECT *, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY {keys} ORDER BY rest DESC, label)
  <= total - sum(fl) OVER (PARTITION BY {keys}) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM {name}_c)"""


COUNTS = "counts AS (SELECT client_id, label, count(*) AS n FROM flows GROUP BY ALL)"


def draws(quotas: str, rows: str, where: str = "true", name: str = "drawn", group: str = "label") -> str:
    """Draws with replacement through hashed slots."""
    return f"""{name}_d AS (SELECT client_id, {group}, n, unnest(range(1, quota + 1)) AS draw FROM {quotas} WHERE {where}),
{name}_s AS (SELECT client_id, {group}, draw,
  CAST('0x' || substr({key("'42'", "client_id", group, "draw")}, 1, 15) AS BIGINT) % n + 1 AS slot FROM {name}_d),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY client_id, {group} ORDER BY {key("'42'", "row_id")}) AS slot FROM {rows}),
{name} AS (SELECT r.*, s.draw FROM {name}_s s JOIN {name}_r r USING (client_id, {group}, slot))"""


def split(rows: str, name: str = "splits", counts: str = "split_counts") -> str:
    return f"""{counts} AS (SELECT client_id, label, count(*) AS n FROM {rows} GROUP BY ALL),
{shares(counts, f"ceil({dbl(0.2)} * ns)", "split_quotas")},
{name} AS (SELECT r.*, CASE WHEN row_number() OVER (PARTITION BY r.client_id, r.label ORDER BY {key("'42'", "r.row_id")})
  <= CASE WHEN q.n = 1 THEN 0 ELSE q.quota END THEN 'val' ELSE 'train' END AS split
  FROM {rows} r JOIN split_quotas q USING (client_id, label))"""


def stats(features: list[str]) -> str:
    cols = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in features)
    return f"stats AS (SELECT client_id, count(*) AS n, {cols} FROM flows GROUP BY 1)"


def score(features: list[str]) -> str:
    total = " + ".join(f"CASE WHEN s_{f} > 0 THEN abs(({f} - m_{f}) / s_{f}) ELSE 0 END" for f in features)
    return f"CAST(round(({total}) * 1000000) AS BIGINT)"


def by_tier(i: int) -> str:
    return "CASE quality " + " ".join(f"WHEN '{q}' THEN {dbl(v[i])}" for q, v in NOISE.items()) + " END"


SCORED = f"""scored AS (SELECT f.*, s.n, CASE WHEN quality = 'compromised' THEN {score(FEATURES)} ELSE 0 END AS score
  FROM flows f JOIN stats s USING (client_id))"""
NOISY = f"""noisy AS (SELECT * EXCLUDE (label), label AS label_clean, CASE WHEN flipped THEN 1 - label ELSE label END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY score DESC, {key("'42'", "'flip'", "row_id")}) <= floor(n * {by_tier(0)}) AS flipped FROM scored))"""
NOISY_CHAIN = (FLOWS, stats(FEATURES), SCORED, NOISY)
AGREEMENT = "agreement AS (SELECT client_id, quality, round, row_id, label_clean AS y_true, label AS y_pred FROM noisy)"
AGREEMENT_CHAIN = (*NOISY_CHAIN, AGREEMENT)

RATES = ["accuracy", "precision", "recall", "f1_score", "false_positive_rate", "true_positive_rate",
         "true_negative_rate", "false_negative_rate"]


def ratio(a: str, b: str) -> str:
    return f"coalesce({dbl(a)} / nullif({dbl(b)}, 0), 0)"


def evaluation(rows: str, by: str, name: str = "metrics") -> str:
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""{name}_c AS (SELECT {head}count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM {rows} {group}),
{name} AS (SELECT *, {ratio('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {ratio('tp', 'tp + fp')} AS precision,
  {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1_score,
  {ratio('fp', 'fp + tn')} AS false_positive_rate, {ratio('tp', 'tp + fn')} AS true_positive_rate,
  {ratio('tn', 'tn + fp')} AS true_negative_rate, {ratio('fn', 'fn + tp')} AS false_negative_rate FROM {name}_c)"""


METRICS_CHAIN = (*AGREEMENT_CHAIN, evaluation("agreement", "client_id, quality, round"))


def majority(table: str, extra: str, name: str) -> str:
    """Static trust from a metrics table."""
    share = ratio("greatest(tn + fp, fn + tp)", "tn + fp + fn + tp")
    return f"""{name} AS (SELECT {extra}, accuracy, {share} AS majority_ratio,
  least(greatest(CASE WHEN {share} > 0.9 AND accuracy > 0.95 THEN accuracy * {dbl(0.75)} ELSE accuracy END, 0), 1) AS computed FROM {table})"""


OBSERVED = majority("metrics", "client_id, round", "observed")


def history(observed: str = "observed", name: str = "history", alpha: float = 0.7, first: str = "direct", decay: bool = False) -> str:
    """Recursive twin of the adaptive fold; `observed` has client_id, round, computed."""
    a = f"CASE WHEN o.computed < 0.2 THEN {dbl(alpha)} * {dbl(0.3)} ELSE {dbl(alpha)} END"
    direct = "o.computed < 0.1" + (" OR o.seq = 1 OR o.round = 1" if first == "direct" else "")
    update = f"CASE WHEN {direct} THEN o.computed ELSE ({a}) * h.trust + (1 - ({a})) * o.computed END"
    new = f"CASE WHEN o.computed IS NULL THEN h.trust * {dbl(0.95)} ELSE {update} END" if decay else update
    event = "CASE WHEN o.computed IS NULL THEN 'decay' ELSE 'update' END"
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round) AS seq FROM {observed}),
{name} AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS round, {dbl(0.5)} AS trust, CAST(NULL AS DOUBLE) AS computed, 'initial' AS event FROM {observed}
  UNION ALL SELECT o.client_id, o.seq, CAST(o.round AS BIGINT), least(greatest({new}, 0), 1), o.computed, {event}
  FROM {name} h JOIN {name}_o o ON o.client_id = h.client_id AND o.seq = h.seq + 1)"""


HISTORY_CHAIN = (*METRICS_CHAIN, OBSERVED, history())
LATEST = "latest AS (SELECT client_id, max(round) AS round, max_by(trust, round) AS trust FROM history GROUP BY 1)"


def steady(value: str, frame: str) -> str:
    w = f"OVER (PARTITION BY client_id ORDER BY round {frame})"
    return f"CASE WHEN count({value}) {w} < 2 THEN 1.0::DOUBLE ELSE greatest(0, 1 - var_pop({value}) {w} / 0.25::DOUBLE) END"


def trend(slope: str) -> str:
    return f"CASE WHEN {slope} > 0.01 THEN 'improving' WHEN {slope} < -0.01 THEN 'declining' ELSE 'stable' END"


def slope(value: str, frame: str) -> str:
    w = f"OVER (PARTITION BY client_id ORDER BY round {frame})"
    return f"CASE WHEN count({value}) {w} >= 2 THEN regr_slope({value}, rn) {w} END"


PAST5 = "ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING"
LAST5 = "ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def numbered(table: str, name: str = "numbered") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round) AS rn FROM {table})"


def described(value: str, table: str) -> tuple[str, str]:
    return (
        numbered(table),
        f"described AS (SELECT *, {steady(value, LAST5)} AS consistency, {slope(value, LAST5)} AS slope FROM numbered)",
    )


def evolved(table: str = "history") -> tuple[str, str, str]:
    return (
        numbered(table),
        f"stepped AS (SELECT *, trust - lag(trust) OVER (PARTITION BY client_id ORDER BY round) AS step, {slope('trust', LAST5)} AS slope FROM numbered)",
        f"""evolved AS (SELECT *, final_trust - initial_trust AS total_change,
  CASE WHEN initial_trust > 0 THEN (final_trust - initial_trust) / initial_trust * 100 ELSE 0 END AS percent_change, {trend('slope')} AS trend
  FROM (SELECT client_id, count(*) - 1 AS rounds, min_by(trust, round) AS initial_trust, max_by(trust, round) AS final_trust,
  avg(step) AS avg_change, max(step) AS max_increase, min(step) AS max_decrease, max_by(coalesce(slope, 0), round) AS slope FROM stepped GROUP BY 1) WHERE rounds > 0)""",
    )


def weights(table: str, by: str, name: str, floor: str = "0", beta: str = "0.8", extra: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    p = f"CASE WHEN greatest(trust, 0) >= {dbl(floor)} AND trust > 0 THEN pow(trust, {dbl(beta)}) ELSE 0 END"
    return f"""{name} AS (SELECT * EXCLUDE (p, t, k), CASE WHEN t > 0 THEN p / t ELSE 1.0::DOUBLE / k END AS weight, t <= 0 AS fallback FROM (
  SELECT *, sum(p) OVER ({part}) AS t, count(*) OVER ({part}) AS k FROM (SELECT *, {p} AS p FROM {table})))"""


QUOTAS = """demand AS (SELECT *, greatest(least(CAST(floor(round(weight * k * 2000.0::DOUBLE, 6)) AS BIGINT), 2000), 0) AS quota
  FROM (SELECT *, count(*) OVER () AS k FROM weighted))"""
DEMAND_CHAIN = (*HISTORY_CHAIN, LATEST, weights("latest", "", "weighted", "0.6"), QUOTAS)

USERS = """user_events AS (SELECT 'user_' || user_id AS client_id, CAST(date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) + 1 AS BIGINT) AS round,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_true, CASE WHEN value > 50 THEN 1 ELSE 0 END AS y_pred FROM events)"""
DAILY = "daily AS (SELECT client_id, round, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END) AS computed FROM user_events GROUP BY ALL)"
USER_CHAIN = (USERS, DAILY, history("daily"))

WEEKLY = """weekly AS (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_true, value AS score FROM events)"""
RATED = """rated AS (SELECT d.source AS client_id, CAST(quality AS INTEGER) AS y_true, CASE WHEN n_chars BETWEEN 200 AND 20000 THEN 1 ELSE 0 END AS y_pred
  FROM documents d JOIN labels USING (doc_id))"""

VECTORS = """vectors AS (SELECT 'client_' || (vec_id % 5) AS client_id, CAST((vec_id // 5) % 7 + 1 AS BIGINT) AS round, CAST(vec_id AS VARCHAR) AS row_id,
  CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label < 5 THEN 0 ELSE 1 END AS label FROM embeddings)"""
CELLS = "cells AS (SELECT client_id, round, row_id, label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM vectors)"


def centroids(by: str, name: str = "models", rows: str = "cells") -> str:
    """Long parameters (`by`, pos, w) and (`by`, b)."""
    return f"""{name}_m AS (SELECT {by}, pos, avg(v) FILTER (label = 0) AS m0, avg(v) FILTER (label = 1) AS m1 FROM {rows} GROUP BY {by}, pos),
{name}_w AS (SELECT {by}, pos, m1 - m0 AS w, (m0 * m0 - m1 * m1) / 2 AS b FROM {name}_m WHERE m0 IS NOT NULL AND m1 IS NOT NULL),
{name}_b AS (SELECT {by}, sum(b) AS b FROM {name}_w GROUP BY {by})"""


def proba(z: str) -> str:
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-least(greatest({z}, -50), 50)))"


def scoring(on: str, name: str = "scored_v", model: str = "models") -> str:
    return f"""{name} AS (SELECT client_id, round, row_id, label, p AS y_proba, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS y_pred, label AS y_true FROM (
  SELECT c.client_id, c.round, c.row_id, c.label, {proba('sum(c.v * w.w) + any_value(b.b)')} AS p
  FROM cells c JOIN {model}_w w USING ({on}, pos) JOIN {model}_b b USING ({on}) GROUP BY c.client_id, c.round, c.row_id, c.label))"""


VECTOR_WEIGHTS = (
    VECTORS, CELLS, centroids("client_id"), scoring("client_id"), evaluation("scored_v", "client_id", "own"),
    "own_trust AS (SELECT client_id, accuracy AS trust FROM own)", weights("own_trust", "", "vw"),
)
PARAMS = "params AS (SELECT client_id, pos, w AS value FROM models_w UNION ALL SELECT client_id, -1, b FROM models_b)"


def entropy(p: str) -> str:
    one = f"greatest(least({p}, 1 - 1e-10::DOUBLE), 1e-10::DOUBLE)"
    two = f"greatest(least(1 - {p}, 1 - 1e-10::DOUBLE), 1e-10::DOUBLE)"
    return f"-({one} * ln({one}) + {two} * ln({two}))"


DRIFT = (
    "round_params AS (SELECT client_id, round, pos, w AS value FROM models_w UNION ALL SELECT client_id, round, -1, b FROM models_b)",
    "round_pairs AS (SELECT *, lag(value) OVER (PARTITION BY client_id, pos ORDER BY round) AS before FROM round_params)",
    """drift AS (SELECT client_id, round, CASE WHEN count(before) = 0 THEN 1 ELSE 1 - least(1, sqrt(sum((value - before) * (value - before))) / 10) END AS drift
  FROM round_pairs GROUP BY ALL)""",
)
SIGNAL_CHAIN = (
    VECTORS, CELLS, centroids("client_id, round"), scoring("client_id, round"), evaluation("scored_v", "client_id, round", "vm"), *DRIFT,
    f"ent AS (SELECT client_id, round, avg({entropy('y_proba')}) AS entropy FROM scored_v GROUP BY ALL)",
    f"""signals AS (SELECT vm.client_id, vm.round, f1_score, {steady('accuracy', PRIOR)} AS stability, drift, entropy,
  1 - least(1, entropy / ln(2.0::DOUBLE)) AS uncertainty FROM vm JOIN drift USING (client_id, round) JOIN ent USING (client_id, round))""",
)
FUSED = f"least(greatest((f1_score + {dbl(0.3)} * stability + {dbl(0.2)} * drift + {dbl(0.2)} * uncertainty) / {dbl(1.7)}, 0), 1)"


def noise_value(sigmas: float, only: bool) -> str:
    noisy = f"x + {normal('h')} * (coalesce(s, 0) * {dbl(sigmas)})"
    if only:
        return noisy
    return f"CASE WHEN {hex_uniform('h', 25)} < 0.5 THEN {noisy} ELSE lo + {hex_uniform('h', 9)} * (hi - lo) END"


def corruption(rows: str, features: list[str], picked: str, sigmas: float = 3.0, only: bool = False, targeted: bool = False, name: str = "spoiled") -> str:
    """`rows` with `features` replaced in picked rows; one wide row per row_id."""
    names = ", ".join(f"'{f}'" for f in features)
    values = ", ".join(f"{dbl(f)}" for f in features)
    keep = max(5, int(len(features) * 0.2)) if targeted and len(features) > 5 else len(features)
    take = f"greatest(1, CAST(floor(size * 0.3) AS INTEGER))" if targeted else str(max(1, int(len(features) * 0.1)))
    alive = "WHERE s > 0" if targeted and len(features) > 5 else ""
    rank = "row_number() OVER (PARTITION BY client_id ORDER BY s DESC)" if keep < len(features) else "0"
    back = ", ".join(f"max(CASE WHEN f = '{f}' THEN nx END) AS {f}" for f in features)
    return f"""{name}_p AS (SELECT *, {picked} AS corrupted FROM {rows}),
{name}_l AS (SELECT row_id, client_id, corrupted, unnest([{names}]) AS f, unnest([{values}]) AS x FROM {name}_p),
{name}_s AS (SELECT client_id, f, stddev_samp(x) AS s, min(x) AS lo, max(x) AS hi FROM {name}_l GROUP BY ALL),
{name}_o AS (SELECT client_id, f FROM (SELECT client_id, f, {rank} AS r FROM {name}_s {alive}) WHERE r <= {keep}),
{name}_k AS (SELECT client_id, {take} AS k FROM (SELECT client_id, count(*) AS size FROM {name}_o GROUP BY 1)),
{name}_c AS (SELECT row_id, f, h, row_number() OVER (PARTITION BY row_id ORDER BY h) <= k AS hit FROM (
  SELECT l.row_id, l.f, k, {key("'42'", "'feature'", "l.row_id", "l.f")} AS h
  FROM {name}_l l JOIN {name}_o o USING (client_id, f) JOIN {name}_k USING (client_id) WHERE l.corrupted)),
{name}_n AS (SELECT row_id, f, CASE WHEN coalesce(hit, false) THEN {noise_value(sigmas, only)} ELSE x END AS nx
  FROM {name}_l JOIN {name}_s USING (client_id, f) LEFT JOIN {name}_c USING (row_id, f)),
{name} AS (SELECT p.* EXCLUDE ({', '.join(features)}), w.* EXCLUDE (row_id) FROM {name}_p p
  JOIN (SELECT row_id, {back} FROM {name}_n GROUP BY 1) w USING (row_id))"""


FEATURE_OUT = f"{rnd('quantity', 4)}, {rnd('extendedprice', 2)}, {rnd('discount', 5)}, {rnd('tax', 5)}"


def first_rows(ratio_: str, *tag: str) -> str:
    """Rank test for the first floor(n * ratio) rows of a source."""
    return f"row_number() OVER (PARTITION BY client_id ORDER BY {key(chr(39) + '42' + chr(39), *tag, 'row_id')}) <= floor(count(*) OVER (PARTITION BY client_id) * {ratio_})"


def rates_out(names: list[str]) -> str:
    return ", ".join(rnd(n) for n in names)


DEGRADED = (
    FLOWS,
    f"worse AS (SELECT * REPLACE (CASE WHEN flipped THEN 1 - label ELSE label END AS label) FROM (SELECT *, {first_rows(dbl(0.5) + ' * ' + dbl(0.3), chr(39) + 'flip' + chr(39))} AS flipped FROM flows))",
    corruption("worse", FEATURES, first_rows(dbl(0.5) + " * " + dbl(0.2), "'corrupt'"), 2.0, True),
)

MELTED = "SELECT {keys}, unnest([{names}]) AS metric, unnest([{values}]) AS value FROM {table}"


def melt(table: str, keys: str, names: list[str], name: str) -> str:
    quoted = ", ".join(f"'{n}'" for n in names)
    return f"{name} AS (" + MELTED.format(keys=keys, names=quoted, values=", ".join(names), table=table) + ")"


TIER_RESULTS = (*AGREEMENT_CHAIN, evaluation("agreement", "quality", "tm"), melt("tm", "quality AS approach", RATES, "results"))
TRIAL_METRICS = ["accuracy", "f1_score", "precision", "recall"]
TRIALS = (*METRICS_CHAIN, melt("metrics", "quality AS variant, client_id, round", TRIAL_METRICS, "trials"))
TRIAL_STATS = """trial_table AS (SELECT variant, metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std_pop,
  coalesce(stddev_samp(value), 0) AS std_sample, min(value) AS min, max(value) AS max, max(value) - min(value) AS range FROM trials GROUP BY ALL)"""

ROC = (
    WEEKLY,
    "points AS (SELECT score, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM weekly GROUP BY 1)",
    "curve AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM points)",
)

LOG_TITLES = ["accuracy", "f1_score", "precision", "recall"]
LOGS = "logs AS (SELECT client_id, " + ", ".join(
    f"round({fn}({m}), 4) AS {tag}_{m}" for m in LOG_TITLES for tag, fn in (("lo", "min"), ("mid", "avg"), ("hi", "max"), ("sd", "stddev_pop"))
) + " FROM metrics GROUP BY 1)"
LOG_APPROACHES = {"centralized": "lo", "equal_weight": "mid", "trust_weighted": "hi"}

TS = "(round + 1994) || '-12-31T00:00:00' AS ts"
BETAS = [0.5, 0.8, 1.0, 1.2]
LAMBDA_SETS = [(1.0, 0.0, 0.0, 0.0), (1.0, 0.3, 0.0, 0.0), (1.0, 0.3, 0.2, 0.0), (1.0, 0.3, 0.2, 0.2)]


def _lambda_case() -> str:
    parts = []
    for i, (a, s, d, u) in enumerate(LAMBDA_SETS):
        total = f"({dbl(a)} + {dbl(s)} + {dbl(d)} + {dbl(u)})"
        parts.append(f"WHEN {i} THEN least(greatest(({dbl(a)} * f1_score + {dbl(s)} * stability + {dbl(d)} * drift + {dbl(u)} * uncertainty) / {total}, 0), 1)")
    return "CASE setting " + " ".join(parts) + " END"


def _report() -> str:
    p0, r0, f0 = ratio("tn", "tn + fn"), ratio("tn", "tn + fp"), ratio("2 * tn", "2 * tn + fn + fp")
    p1, r1, f1 = ratio("tp", "tp + fp"), ratio("tp", "fn + tp"), ratio("2 * tp", "2 * tp + fp + fn")
    n0, n1 = "(tn + fp)", "(fn + tp)"
    w = lambda a, b: ratio(f"({a}) * {n0} + ({b}) * {n1}", f"{n0} + {n1}")
    lines = [
        ("0", p0, r0, f0, n0), ("1", p1, r1, f1, n1),
        ("macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", f"{n0} + {n1}"),
        ("weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), f"{n0} + {n1}"),
    ]
    return " UNION ALL ".join(
        f"SELECT client_id, '{name}' AS class, {rnd(p, name='precision')}, {rnd(r, name='recall')}, {rnd(f, name='f1_score')}, CAST({n} AS BIGINT) AS support FROM cm_c"
        for name, p, r, f, n in lines
    )


BANDS = {
    "trust": "CASE WHEN t >= 0.9 THEN 'very high' WHEN t >= 0.7 THEN 'high' WHEN t >= 0.5 THEN 'medium' WHEN t >= 0.3 THEN 'low' ELSE 'very low' END",
    "accuracy": "CASE WHEN t >= 0.7 THEN 'high' WHEN t >= 0.5 THEN 'medium' ELSE 'low' END",
    "reliance": "CASE WHEN t > 0.8 THEN 'trusted' WHEN t < 0.7 THEN 'doubtful' ELSE 'between' END",
}
USER_LATEST = (*USER_CHAIN, "latest AS (SELECT client_id, round(max_by(trust, round), 9) AS t FROM history GROUP BY 1)")

CLIENT_EVENTS = """client_events AS (SELECT 'client_' || (user_id % 12) AS client_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_true,
  CASE WHEN value > 50 THEN 1 ELSE 0 END AS y_pred FROM events)"""
WEEKS = """weeks AS (SELECT * FROM (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY AS window_end FROM client_events)
  WHERE window_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM events))"""
WEEK_ROWS = f"SELECT client_id, CAST(window_end AS TIMESTAMP) AS window_end, tn, fp, fn, tp, {rates_out(['accuracy', 'f1_score'])} FROM wm"
USER_DAYS = """user_days AS (SELECT 'user_' || user_id AS client_id, CAST(ts AS DATE) AS day,
  avg(CASE WHEN (event_type = 'error') = (value > 50) THEN 1.0::DOUBLE ELSE 0 END) AS computed FROM events GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "scan_union": with_(FLOWS, final=f"""SELECT client_id, row_id,
  {rnd('CASE WHEN supplier % 2 = 0 THEN 0 ELSE discount END', name='discount')}, {rnd('CASE WHEN supplier % 2 = 0 THEN 0 ELSE extendedprice END', name='extendedprice')},
  {rnd('CASE WHEN supplier % 2 = 0 THEN quantity ELSE 0 END', name='quantity')}, {rnd('CASE WHEN supplier % 2 = 0 THEN tax ELSE 0 END', name='tax')} FROM flows"""),
    "source_preference": with_(FLOWS, NAMED, KINDS, PREFERRED, final="SELECT source_name, count(*) AS n FROM preferred GROUP BY 1"),
    "source_identity": with_(FLOWS, NAMED, KINDS, PREFERRED, final="""SELECT source_name, ordinal, 'client_' || ordinal || '_' || regexp_replace(source_name, '\\.[^.]*$', '') AS client_id,
  CASE WHEN regexp_extract(source_name, '(high|medium|low|compromised)_quality', 1) <> '' THEN regexp_extract(source_name, '(high|medium|low|compromised)_quality', 1)
  WHEN source_name LIKE '%\\_compromised\\_%' ESCAPE '\\' THEN 'compromised' ELSE 'unknown' END AS quality, regexp_extract(source_name, 'mixed_[^.]+\\.csv', 0) AS parent
  FROM (SELECT source_name, dense_rank() OVER (ORDER BY source_name) AS ordinal FROM (SELECT DISTINCT source_name FROM preferred))"""),
    "benign_scan": with_(FLOWS, NAMED, final="SELECT source_name, count(*) AS n FROM named WHERE lower(source_name) LIKE '%benign%' GROUP BY 1"),
    "reserve_source": with_(FLOWS, NAMED, """names AS (SELECT DISTINCT source_name, CASE WHEN lower(source_name) LIKE '%test\\_set%' ESCAPE '\\' THEN 1
  WHEN source_name LIKE 'mixed\\_%' ESCAPE '\\' THEN 2 WHEN lower(source_name) LIKE '%high\\_quality%' ESCAPE '\\' THEN 3
  WHEN lower(source_name) LIKE '%medium\\_quality%' ESCAPE '\\' THEN 4 ELSE 5 END AS p FROM named WHERE lower(source_name) NOT LIKE '%benign%')""",
        "reserved AS (SELECT CASE WHEN p = 5 THEN max(source_name) ELSE min(source_name) END AS source_name FROM names WHERE p = (SELECT min(p) FROM names) GROUP BY p)",
        final="""SELECT source_name, count(*) AS n, 'train' AS role FROM named WHERE source_name NOT IN (SELECT source_name FROM reserved) GROUP BY 1
  UNION ALL SELECT source_name, NULL, 'reserved' FROM reserved"""),
    "label_binary": with_(FLOWS, """raw AS (SELECT client_id, row_id, CASE WHEN supplier % 12 < 4 THEN CASE WHEN quantity > 25 THEN lower(label_raw) ELSE label_raw END
  WHEN supplier % 12 < 8 THEN CAST(label AS VARCHAR) WHEN tax <> 0 THEN CAST(label AS VARCHAR) END AS label_text FROM flows)""",
        "kinds AS (SELECT client_id, bool_and(coalesce(TRY_CAST(label_text AS DOUBLE) IN (0, 1), false)) AS is_binary FROM raw GROUP BY 1)",
        final="""SELECT client_id, row_id, label_text, CASE WHEN is_binary THEN CAST(TRY_CAST(label_text AS DOUBLE) AS INTEGER)
  WHEN upper(label_text) = 'BENIGN' THEN 0 ELSE 1 END AS label FROM raw JOIN kinds USING (client_id)"""),
    "features_finite": with_(FLOWS, BROKEN, final="SELECT row_id AS flow_id, " + ", ".join(rnd(finite(f), name=f) for f in sorted(FEATURES)) + " FROM broken"),
    "clip": with_(FLOWS, BROKEN, CLEANED, final=f"SELECT row_id, {rates_out(FEATURES)} FROM cleaned"),
    "standardise": with_(FLOWS, BROKEN, CLEANED, "cs AS (SELECT client_id, " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS d_{f}" for f in FEATURES) + " FROM cleaned GROUP BY 1)",
        final="SELECT client_id, row_id, " + ", ".join(rnd(f"({f} - m_{f}) / (CASE WHEN d_{f} = 0 THEN 1 ELSE d_{f} END + 1e-8::DOUBLE)", 5, f) for f in FEATURES) + " FROM cleaned JOIN cs USING (client_id)"),
    "align": with_(FLOWS, final=f"SELECT row_id, {rnd('discount')}, 0.0::DOUBLE AS duration, {rnd('quantity')}, {rnd('tax')} FROM flows"),
    "exclude_sources": with_(FLOWS, NAMED, final="SELECT source_name, count(*) AS n FROM named WHERE NOT regexp_matches(lower(source_name), 'low_quality|benign|s13') GROUP BY 1"),
    "class_filter": with_(FLOWS, final="SELECT client_id, row_id, label FROM flows WHERE label = 0"),
    "first_sources": with_(FLOWS, NAMED, final="""SELECT source_name, count(*) AS n FROM named WHERE source_name IN (SELECT DISTINCT source_name FROM named ORDER BY 1 LIMIT 5)
  AND lower(source_name) NOT LIKE '%benign%' GROUP BY 1"""),

    "split_stratified": with_(FLOWS, split("flows"), final="SELECT client_id, row_id, label, split FROM splits"),
    "split_plain": with_(FLOWS, final=f"""SELECT client_id, row_id, CASE WHEN row_number() OVER (PARTITION BY client_id ORDER BY {key("'42'", "row_id")})
  <= ceil(count(*) OVER (PARTITION BY client_id) * {dbl(0.2)}) THEN 'val' ELSE 'train' END AS split FROM flows"""),
    "bootstrap_capped": with_(FLOWS, COUNTS, shares("counts", "2000"), draws("quotas", "flows", "ns > 2000"),
        final="""SELECT client_id, row_id, label, draw FROM drawn UNION ALL SELECT client_id, row_id, label, 0 FROM flows
  WHERE client_id IN (SELECT client_id FROM quotas WHERE ns <= 2000)"""),
    "sample_capped": with_(FLOWS, COUNTS, shares("counts", "2000"), final=f"""SELECT client_id, row_id, label FROM (SELECT f.*, ns, quota,
  row_number() OVER (PARTITION BY client_id, label ORDER BY {key("'42'", "row_id")}) AS r FROM flows f JOIN quotas USING (client_id, label)) WHERE ns <= 2000 OR r <= quota"""),
    "trust_quota_sample": with_(*DEMAND_CHAIN, "allowed AS (SELECT client_id, label, count(*) AS n, any_value(d.quota) AS want FROM flows JOIN demand d USING (client_id) WHERE d.quota > 0 GROUP BY ALL)",
        shares("allowed", "want", "qs"), draws("qs", "flows", "ns > want"),
        final="""SELECT client_id, row_id, label, draw FROM drawn UNION ALL SELECT client_id, row_id, label, 0 FROM flows
  WHERE client_id IN (SELECT client_id FROM qs WHERE ns <= want)""", recursive=True),
    "class_ratio_sample": with_(FLOWS, final=f"""SELECT client_id, row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {key("'42'", "client_id", "row_id")}) AS r FROM flows)
  WHERE r <= CASE WHEN label = 0 THEN 2000 WHEN (SELECT count(*) FROM flows WHERE label = 0) > 0 THEN 8000 ELSE 10000 END"""),
    "mix_benign": with_(FLOWS, "pool AS (SELECT * FROM flows WHERE supplier % 12 < 3 AND label = 0)", "attack AS (SELECT * FROM flows WHERE supplier % 12 >= 3)",
        f"""needs AS (SELECT client_id, CAST(floor(count(*) FILTER (label = 1) * {dbl(0.6)} / ({dbl(1)} - {dbl(0.6)})) AS BIGINT) - count(*) FILTER (label = 0) AS need FROM attack GROUP BY 1)""",
        f"""ranked AS (SELECT row_id, label, row_number() OVER (ORDER BY {key("'42'", "client_id", "row_id")}) AS r FROM pool)""",
        final="""SELECT client_id, row_id, label, false AS mixed_in FROM attack WHERE client_id IN (SELECT client_id FROM needs WHERE need > 0)
  UNION ALL SELECT n.client_id, r.row_id, r.label, true FROM needs n JOIN ranked r ON r.r <= n.need"""),
    "resize": with_(FLOWS, "counts AS (SELECT client_id, label, count(*) AS n, CASE any_value(quality) WHEN 'high' THEN 25000 WHEN 'medium' THEN 5000 WHEN 'low' THEN 3000 ELSE 25000 END AS target FROM flows GROUP BY ALL)",
        shares("counts", "target"), draws("quotas", "flows", "ns <> target"),
        final="SELECT client_id, row_id, label, draw FROM drawn UNION ALL SELECT client_id, row_id, label, 0 FROM flows WHERE client_id IN (SELECT client_id FROM quotas WHERE ns = target)"),
    "rebalance": with_(FLOWS, "cs AS (SELECT client_id, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) // 2 AS half FROM flows GROUP BY 1)",
        "plan AS (SELECT *, CASE WHEN n0 < n1 THEN 0 ELSE 1 END AS minor, least(n0, n1) AS small FROM cs WHERE least(n0, n1) > 0 AND n0 <> n1 AND half - least(n0, n1) > 0)",
        "tops AS (SELECT client_id, minor AS label, small AS n, least(half - small, small) AS quota FROM plan)", draws("tops", "flows"),
        f"""ranked AS (SELECT f.*, row_number() OVER (PARTITION BY client_id, label ORDER BY {key("'42'", "row_id")}) AS r FROM flows f)""",
        final="""SELECT client_id, row_id, label, draw FROM drawn UNION ALL SELECT client_id, row_id, r.label, 0 FROM ranked r LEFT JOIN plan p USING (client_id)
  WHERE p.minor IS NULL OR r.label = p.minor OR r.r <= p.half"""),
    "shuffle_key": with_(FLOWS, final=f"""SELECT row_id, {key("'42'", "row_id")} AS shuffle_key FROM flows"""),
    "clean_validation": with_(*NOISY_CHAIN, split("noisy"), final="""SELECT client_id, quality, row_id, CASE WHEN quality IN ('medium', 'low') THEN label_clean ELSE label END AS label,
  quality IN ('medium', 'low') AS from_parent FROM splits WHERE split = 'val'"""),

    "flip_random": with_(FLOWS, final=f"""SELECT client_id, row_id, CASE WHEN NOT flipped THEN label_raw WHEN label_raw = 'BENIGN' THEN 'ATTACK' ELSE 'BENIGN' END AS label_raw, flipped
  FROM (SELECT *, {first_rows(dbl(0.25), "'flip'")} AS flipped FROM flows)"""),
    "flip_bernoulli": with_(FLOWS, final=f"""SELECT client_id, row_id, CASE WHEN flipped THEN 1 - label ELSE label END AS label, flipped
  FROM (SELECT *, {uniform("'42'", "'flip'", "row_id")} < 0.25 AS flipped FROM flows)"""),
    "flip_adversarial": with_(FLOWS, stats(FEATURES), final=f"""SELECT client_id, row_id, CASE WHEN flipped THEN 1 - label ELSE label END AS label, flipped FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY score DESC, {key("'42'", "'flip'", "row_id")}) <= floor(n * {dbl(0.4)}) AS flipped
  FROM (SELECT f.*, n, {score(FEATURES)} AS score FROM flows f JOIN stats USING (client_id)))"""),
    "corrupt_random": with_(FLOWS, corruption("flows", FEATURES, first_rows(dbl(0.35), "'corrupt'")), final=f"SELECT client_id, row_id, corrupted, {FEATURE_OUT} FROM spoiled"),
    "corrupt_targeted": with_(FLOWS, "wide AS (SELECT *, extendedprice * (1 - discount) AS net, extendedprice / quantity AS unit, 1.0::DOUBLE AS flat, CAST(year(ts) AS DOUBLE) AS year FROM flows)",
        corruption("wide", [*FEATURES, "net", "unit", "flat", "year"], first_rows(dbl(0.95), "'corrupt'"), targeted=True),
        final=f"SELECT client_id, row_id, corrupted, {FEATURE_OUT}, {rnd('net', 2)}, {rnd('unit', 2)}, {rnd('flat', 4)}, {rnd('year', 4)} FROM spoiled"),
    "tier_preset": with_(*NOISY_CHAIN, corruption("noisy", FEATURES, first_rows(by_tier(1), "'corrupt'")),
        final=f"SELECT client_id, quality, row_id, label, flipped, corrupted, {FEATURE_OUT} FROM spoiled"),
    "degrade": with_(*DEGRADED, final=f"SELECT client_id, row_id, label, flipped, corrupted, {FEATURE_OUT} FROM spoiled"),
    "restore": with_(*DEGRADED, "back AS (SELECT s.client_id, s.row_id, s.label, o.label AS old, " + ", ".join(f"{dbl(0.6)} * s.{f} + {dbl(0.4)} * o.{f} AS {f}" for f in FEATURES)
        + f", {first_rows(dbl(0.4), chr(39) + 'restore' + chr(39)).replace('client_id', 's.client_id').replace('row_id', 's.row_id')} AS restored FROM spoiled s JOIN flows o USING (row_id))",
        final=f"SELECT client_id, row_id, CASE WHEN restored THEN old ELSE label END AS label, restored, {FEATURE_OUT} FROM back"),

    "confusion": with_(*METRICS_CHAIN, final=f"SELECT client_id, round, tn, fp, fn, tp, {rates_out(RATES)} FROM metrics"),
    "join_predictions": with_(*AGREEMENT_CHAIN, evaluation("agreement", "quality", "tm"), final=f"SELECT quality, tn, fp, fn, tp, {rates_out(RATES)} FROM tm"),
    "class_report": with_(*AGREEMENT_CHAIN, evaluation("agreement", "client_id", "cm"), final=_report()),
    "class_distribution": with_(*NOISY_CHAIN, split("noisy"), final=f"""SELECT coalesce(client_id, 'all') AS client_id, coalesce(split, 'all') AS split, count(*) AS n,
  count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS attack, {rnd(ratio('count(*) FILTER (label = 0)', 'count(*)'), name='benign_ratio')},
  {rnd(ratio('greatest(count(*) FILTER (label = 0), count(*) FILTER (label = 1))', 'count(*)'), name='majority_ratio')} FROM splits GROUP BY ROLLUP (client_id, split)"""),
    "tier_counts": with_(FLOWS, final="SELECT quality, count(DISTINCT client_id) AS sources FROM flows GROUP BY 1"),
    "eval_set_check": with_(RATED, evaluation("rated", "client_id", "rm"), final="""SELECT client_id, tn + fp AS benign, fn + tp AS attack, tn + fp > 0 AND fn + tp > 0 AS valid,
  CASE WHEN tn + fp + fn + tp = 0 THEN 'no rows' WHEN tn + fp = 0 THEN 'no benign rows' WHEN fn + tp = 0 THEN 'no attack rows'
  ELSE 'benign ' || printf('%.1f%%', round((tn + fp)::DOUBLE / (tn + fp + fn + tp) * 100, 1)) || ' attack ' || printf('%.1f%%', round((fn + tp)::DOUBLE / (tn + fp + fn + tp) * 100, 1)) END AS reason FROM rm"""),
    "compare_approaches": with_(*TIER_RESULTS, final="SELECT metric, " + ", ".join(rnd(f"max(CASE WHEN approach = '{q}' THEN value END)", name=q) for q in NOISE) + " FROM results GROUP BY 1"),
    "ranked_approaches": with_(*TIER_RESULTS, final=f"""SELECT approach, {rnd('value')}, {rnd('best')}, {rnd('best - value', name='gap')}
  FROM (SELECT *, max(value) OVER () AS best FROM results WHERE metric = 'accuracy')"""),
    "improvement": with_(*TIER_RESULTS, "pairs AS (SELECT metric, max(CASE WHEN approach = 'medium' THEN value END) AS a, max(CASE WHEN approach = 'low' THEN value END) AS b FROM results GROUP BY 1)",
        final=f"SELECT metric, {rnd('a', name='value')}, {rnd('b', name='baseline')}, {rnd('a - b', name='gap')}, {rnd(ratio('a - b', 'b') + ' * 100', name='percent')} FROM pairs"),
    "trial_stats": with_(*TRIALS, TRIAL_STATS, final=f"SELECT variant, metric, n, {rates_out(['mean', 'std_pop', 'std_sample', 'min', 'max', 'range'])} FROM trial_table"),
    "t_test": with_(*TRIALS, """moments AS (SELECT metric, count(*) FILTER (variant = 'medium') AS n1, avg(value) FILTER (variant = 'medium') AS m1, var_samp(value) FILTER (variant = 'medium') AS v1,
  count(*) FILTER (variant = 'low') AS n2, avg(value) FILTER (variant = 'low') AS m2, var_samp(value) FILTER (variant = 'low') AS v2 FROM trials GROUP BY 1)""",
        final=f"""SELECT metric, {rnd('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2))', 4, 't')}, {dbl('n1 + n2 - 2')} AS df FROM moments"""),
    # the t quantile at 0.975 for 20 degrees of freedom: three sources over seven rounds
    "confidence_interval": with_(*TRIALS, TRIAL_STATS, final=f"""SELECT variant, metric, {rnd('mean - m', name='low')}, {rnd('mean + m', name='high')},
  printf('%.2f%% ± %.2f%%', round(mean, 8) * 100, round(std_sample, 8) * 100) AS text
  FROM (SELECT *, CASE WHEN n = 21 THEN 2.0859634472658364::DOUBLE * std_sample / sqrt(n) END AS m FROM trial_table)"""),
    "best_config": with_(*HISTORY_CHAIN, LATEST, f"grid AS (SELECT *, unnest([{', '.join(map(dbl, BETAS))}]) AS beta FROM latest)",
        weights("grid", "beta", "wg", "0", "beta"), evaluation("agreement", "client_id", "am"),
        final=f"""SELECT beta, {rnd('weighted_accuracy')} FROM (SELECT beta, round(sum(weight * accuracy), 6) AS weighted_accuracy FROM wg JOIN am USING (client_id) GROUP BY 1)
  ORDER BY weighted_accuracy DESC, beta LIMIT 3""", recursive=True),
    "roc_curve": with_(*ROC, final=f"SELECT {rnd('score', 2, 'threshold')}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {rnd(ratio('tp', 'p'), name='tpr')}, {rnd(ratio('fp', 'n'), name='fpr')} FROM curve"),
    "roc_auc": with_(*ROC, final=f"""SELECT count(*) AS points, CAST(any_value(p) AS BIGINT) AS positives, CAST(any_value(n) AS BIGINT) AS negatives,
  {rnd('sum(neg * (2.0::DOUBLE * tp - pos) / 2) / (any_value(p)::DOUBLE * any_value(n))', name='auc')} FROM curve"""),

    "trust_static": with_(RATED, evaluation("rated", "client_id", "rm"), majority("rm", "client_id", "st"),
        final=f"SELECT client_id, {rates_out(['accuracy', 'majority_ratio'])}, {rnd('computed', name='trust')} FROM st"),
    "signal_stability": with_(*METRICS_CHAIN, final=f"SELECT client_id, round, {rnd('accuracy')}, {rnd(steady('accuracy', PRIOR), name='stability')} FROM metrics"),
    "trust_adaptive": with_(*HISTORY_CHAIN, numbered("history"), final=f"""SELECT client_id, round, {rnd('trust')}, {rnd('computed')},
  {rnd('lag(trust) OVER (PARTITION BY client_id ORDER BY round)', name='previous')}, {rnd(steady('trust', PAST5), name='consistency')}, event,
  {trend(slope('trust', PAST5))} AS trend FROM numbered""", recursive=True),
    "trust_smoothed": with_(*METRICS_CHAIN, OBSERVED, history(alpha=0.5, first="smoothed"), final=f"SELECT client_id, round, {rnd('trust')} FROM history", recursive=True),
    "trust_decay": with_(USERS, DAILY, "spine AS (SELECT client_id, unnest(range(1, (SELECT max(round) + 1 FROM daily))) AS round FROM (SELECT DISTINCT client_id FROM daily))",
        "filled AS (SELECT s.client_id, s.round, d.computed FROM spine s LEFT JOIN daily d USING (client_id, round))", history("filled", decay=True),
        final=f"SELECT client_id, round, CASE WHEN seq = 0 THEN 'initial' ELSE event END AS event, {rnd('trust')} FROM history", recursive=True),
    "trust_drops": with_(*USER_CHAIN, "steps AS (SELECT client_id, round, trust, lag(trust) OVER (PARTITION BY client_id ORDER BY round) AS previous FROM history)",
        final=f"""SELECT client_id, round, 'sudden_drop' AS type, {rnd('previous - trust', name='magnitude')}, {rnd('previous', name='previous_trust')}, {rnd('trust', name='current_trust')}
  FROM steps WHERE previous - trust > {dbl(0.2)}""", recursive=True),
    "consistency_trend": with_(*HISTORY_CHAIN, *described("trust", "history"), final=f"SELECT client_id, round, {rates_out(['consistency', 'slope'])}, {trend('slope')} AS trend FROM described", recursive=True),
    "accuracy_trend": with_(*METRICS_CHAIN, *described("accuracy", "metrics"), final=f"SELECT client_id, round, {rates_out(['consistency', 'slope'])}, {trend('slope')} AS trend FROM described"),
    "trend_counts": with_(*USER_CHAIN, *evolved(), final="SELECT trend, count(*) AS sources FROM evolved GROUP BY 1", recursive=True),
    "trust_weights": with_(*HISTORY_CHAIN, "h AS (SELECT client_id, round, trust FROM history WHERE round > 0)", weights("h", "round", "w1"), weights("h", "round", "w2", "0.99"),
        final=f"""SELECT client_id, round, 'none' AS floor, fallback, {rates_out(['trust', 'weight'])} FROM w1
  UNION ALL SELECT client_id, round, '0.99', fallback, {rates_out(['trust', 'weight'])} FROM w2
  UNION ALL SELECT client_id, round, 'equal', false, {rnd('trust')}, {rnd('1.0::DOUBLE / count(*) OVER (PARTITION BY round)', name='weight')} FROM h""", recursive=True),
    "trust_lookup": with_(*HISTORY_CHAIN, LATEST, final=f"""SELECT client_id, row_id, {rnd('coalesce(l.trust, 0.5)', name='trust')} FROM flows
  LEFT JOIN (SELECT * FROM latest WHERE trust > 0.3) l USING (client_id)""", recursive=True),
    "trust_latest": with_(*HISTORY_CHAIN, LATEST, final=f"SELECT client_id, round, {rnd('trust')} FROM latest", recursive=True),
    "trust_last_rounds": with_(*HISTORY_CHAIN, final=f"""SELECT client_id, round, {rnd('trust')} FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round DESC) AS r FROM history) WHERE r <= 3""", recursive=True),
    "trust_ranking": with_(*HISTORY_CHAIN, "two AS (SELECT *, lag(trust) OVER (PARTITION BY client_id ORDER BY round) AS previous, row_number() OVER (PARTITION BY client_id ORDER BY round DESC) AS r FROM history)",
        final=f"""SELECT client_id, row_number() OVER (ORDER BY trust DESC, client_id) AS rank, round, {rnd('trust')}, {rnd('trust - previous', name='change')},
  CASE WHEN trust - previous > 0.001 THEN 'up' WHEN trust - previous < -0.001 THEN 'down' ELSE 'stable' END AS direction FROM two WHERE r = 1""", recursive=True),
    "trust_evolution": with_(*HISTORY_CHAIN, *evolved(), final=f"""SELECT client_id, rounds,
  {rates_out(['initial_trust', 'final_trust', 'total_change', 'percent_change', 'avg_change', 'max_increase', 'max_decrease'])}, trend FROM evolved""", recursive=True),
    "round_log": with_(*HISTORY_CHAIN, final=f"""SELECT m.client_id, m.round, {', '.join(rnd('m.' + n, name=n) for n in ['accuracy', 'f1_score', 'precision', 'recall', 'false_positive_rate'])},
  {rnd('h.trust', name='trust_score')} FROM metrics m JOIN history h ON h.client_id = m.client_id AND h.round = m.round""", recursive=True),
    "trust_summary": with_(*HISTORY_CHAIN, "s AS (SELECT round, count(*) AS count, avg(trust) AS mean, stddev_pop(trust) AS std, min(trust) AS min, max(trust) AS max, median(trust) AS median FROM history GROUP BY 1)",
        final=f"SELECT round, count, {rates_out(['mean', 'std', 'min', 'max', 'median'])}, {rnd('max - min', name='range')}, max - min > 0.3 AS heterogeneous FROM s", recursive=True),
    "trust_bands": with_(*USER_LATEST, final=" UNION ALL ".join(f"SELECT '{k}' AS kind, {c} AS band, count(*) AS sources FROM latest GROUP BY ALL" for k, c in BANDS.items()), recursive=True),
    "trust_histogram": with_(*USER_LATEST, "e AS (SELECT min(t) AS lo, (max(t) - min(t)) / 10 AS w FROM latest)",
        "b AS (SELECT CASE WHEN w = 0 THEN 0 ELSE least(floor((t - lo) / w), 9) END AS bin, lo, w FROM latest, e)",
        final=f"SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, {rnd('any_value(lo) + bin * any_value(w)', name='low')}, {rnd('any_value(lo) + (bin + 1) * any_value(w)', name='high')} FROM b GROUP BY bin", recursive=True),
    "lambda_sweep": with_(*SIGNAL_CHAIN, "g AS (SELECT *, unnest([0, 1, 2, 3]) AS setting FROM signals)",
        final=f"SELECT client_id, round, CAST(setting AS BIGINT) AS setting, {rnd(_lambda_case(), name='trust')} FROM g"),
    "beta_sweep": with_(*HISTORY_CHAIN, LATEST, f"betas AS (SELECT *, unnest([{', '.join(map(dbl, BETAS))}]) AS beta FROM latest)",
        f"grid AS (SELECT * REPLACE (CASE WHEN trust >= floor THEN trust ELSE 0 END AS trust) FROM (SELECT *, unnest([{dbl(0)}, {dbl(0.6)}]) AS floor FROM betas))",
        weights("grid", "beta, floor", "wg", "0", "beta"), final=f"SELECT client_id, beta, floor, {rates_out(['trust', 'weight'])} FROM wg", recursive=True),
    "history_documents": with_(*HISTORY_CHAIN, numbered("history"), final=f"""SELECT client_id, round, {rnd('trust')}, {TS}, {rnd('computed', name='validation_accuracy')},
  CASE WHEN round > 0 THEN round({steady('trust', PAST5)} + {nudge(6)!r}, 6) + 0.0 END AS consistency_score, CASE WHEN round > 0 THEN {trend(slope('trust', PAST5))} END AS trend FROM numbered""", recursive=True),
    "resume_point": with_(*HISTORY_CHAIN, final=f"""SELECT client_id, round, {rnd('trust')}, {TS}, event FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round DESC) AS r FROM history) WHERE r = 1""", recursive=True),
    "initialise": with_(*HISTORY_CHAIN, LATEST, final="SELECT DISTINCT client_id, CAST(0 AS BIGINT) AS round, 0.5::DOUBLE AS trust FROM flows WHERE client_id NOT IN (SELECT client_id FROM latest WHERE trust > 0.5)", recursive=True),
    "source_trust": with_(*DEMAND_CHAIN, final=f"""SELECT client_id, quality, {rates_out(['trust', 'weight'])}, fallback, quota FROM demand
  JOIN (SELECT DISTINCT client_id, quality FROM flows) USING (client_id)""", recursive=True),

    "linear_score": with_(VECTORS, CELLS, centroids("client_id"), scoring("client_id"), final=f"SELECT client_id, row_id, label, {rnd('y_proba')}, y_pred FROM scored_v"),
    "linear_evaluation": with_(VECTORS, CELLS, centroids("client_id"), "mean_w AS (SELECT pos, avg(w) AS w FROM models_w GROUP BY 1)", "mean_b AS (SELECT avg(b) AS b FROM models_b)",
        f"sv AS (SELECT client_id, label AS y_true, CASE WHEN {proba('sum(v * w) + any_value(b)')} >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM cells JOIN mean_w USING (pos), mean_b GROUP BY client_id, row_id, label)",
        evaluation("sv", "client_id", "em"), final=f"SELECT client_id, tn, fp, fn, tp, {rates_out(['accuracy', 'f1_score'])} FROM em"),
    "ensemble_vote": with_(*VECTOR_WEIGHTS, f"""votes AS (SELECT c.client_id, c.row_id, w.client_id AS model, {proba('sum(c.v * w.w) + any_value(b.b)')} AS p
  FROM cells c JOIN models_w w USING (pos) JOIN models_b b ON b.client_id = w.client_id GROUP BY ALL)""",
        "voted AS (SELECT v.client_id, v.row_id, sum(weight * p) AS y_proba FROM votes v JOIN vw ON vw.client_id = v.model GROUP BY ALL)",
        final=f"SELECT client_id, row_id, {rnd('y_proba')}, CASE WHEN y_proba >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM voted"),
    "param_average": with_(*VECTOR_WEIGHTS, PARAMS, final=f"SELECT CAST(pos AS BIGINT) AS pos, {rnd('sum(weight * value) / sum(weight)', name='value')} FROM params JOIN vw USING (client_id) GROUP BY pos"),
    "param_average_equal": with_(VECTORS, CELLS, centroids("client_id, round"), DRIFT[0], final=f"SELECT CAST(round AS INTEGER) AS round, CAST(pos AS BIGINT) AS pos, {rnd('avg(value)', name='value')} FROM round_params GROUP BY round, pos"),
    "importance_average": with_(*VECTOR_WEIGHTS, final=f"SELECT CAST(pos AS BIGINT) AS pos, {rnd('sum(weight * abs(w)) / sum(weight)', name='value')} FROM models_w JOIN vw USING (client_id) GROUP BY pos"),
    "param_median": with_(VECTORS, CELLS, centroids("client_id, round"), DRIFT[0], final=f"SELECT CAST(pos AS BIGINT) AS pos, {rnd('median(value)', name='value')} FROM round_params GROUP BY pos"),
    "signal_drift": with_(VECTORS, CELLS, centroids("client_id, round"), *DRIFT, final=f"SELECT client_id, round, {rnd('drift')} FROM drift"),
    "signal_entropy": with_(*SIGNAL_CHAIN, final=f"SELECT client_id, round, {rates_out(['entropy', 'uncertainty'])} FROM signals"),
    "fusion": with_(*SIGNAL_CHAIN, final=f"SELECT client_id, round, {rates_out(['f1_score', 'stability', 'drift', 'uncertainty'])}, {rnd(FUSED, name='trust')} FROM signals"),
    "multi_signal_trust": with_(*SIGNAL_CHAIN, f"fused AS (SELECT client_id, round, {FUSED} AS computed FROM signals)", history("fused", alpha=0.5),
        final=f"SELECT client_id, round, {rnd('trust')} FROM history", recursive=True),
    "constant_model": """SELECT CAST(label AS VARCHAR) AS client_id, count(*) AS n, CASE WHEN label < 5 THEN -50.0::DOUBLE ELSE 50.0::DOUBLE END AS intercept,
  0.0::DOUBLE AS norm, CAST(max(len(embedding)) AS BIGINT) AS width, true AS constant FROM embeddings GROUP BY label""",

    "log_metrics": with_(*METRICS_CHAIN, LOGS, final=" UNION ALL ".join(
        f"SELECT client_id, '{a}' AS approach, '{m}' AS metric, {rnd(f'{tag}_{m}', 4, 'mean')}, {rnd(f'sd_{m}', 4, 'std')} FROM logs" for m in LOG_TITLES for a, tag in LOG_APPROACHES.items())),
    "log_comparison": with_(*METRICS_CHAIN, LOGS, final=" UNION ALL ".join(
        [f"SELECT client_id, '{a}' AS approach, '{m}' AS metric, {rnd(f'{tag}_{m}', 4, 'value')} FROM logs" for m in LOG_TITLES[:2] for a, tag in LOG_APPROACHES.items()]
        + [f"SELECT client_id, 'test', 'accuracy', {rnd('mid_accuracy', 4, 'value')} FROM logs"])),
    "result_scan": with_(*METRICS_CHAIN, final=" UNION ALL ".join(
        f"SELECT client_id, round, '{a}' AS approach, '{m}' AS metric, {rnd(m, name='value')} FROM metrics WHERE quality <> 'low'" for a in ("centralized", "trust_aware") for m in TRIAL_METRICS)),
    "stream_round_metrics": with_(CLIENT_EVENTS, WEEKS, evaluation("weeks", "client_id, window_end", "wm"), final=WEEK_ROWS),
    "batch_round_metrics": with_(CLIENT_EVENTS, WEEKS, evaluation("weeks", "client_id, window_end", "wm"), final=WEEK_ROWS),
    "stream_trust": with_(USER_DAYS, "firsts AS (SELECT client_id, min(day) AS first_day FROM user_days GROUP BY 1)",
        "closed AS (SELECT CAST(date_trunc('day', max(ts) - INTERVAL 1 DAY) AS DATE) AS until FROM events)",
        "spine AS (SELECT client_id, first_day + CAST(i AS INTEGER) AS day, i + 1 AS round FROM (SELECT client_id, first_day, unnest(range(0, until - first_day)) AS i FROM firsts, closed))",
        "filled AS (SELECT s.client_id, s.day, s.round, d.computed FROM spine s LEFT JOIN user_days d USING (client_id, day))", history("filled", decay=True),
        "ends AS (SELECT client_id, round, CAST(day + 1 AS TIMESTAMP) AS window_end FROM spine)",
        f"steps AS (SELECT *, lag(trust) OVER (PARTITION BY client_id ORDER BY round) - trust AS fall FROM history)",
        final=f"SELECT client_id, window_end, round, event, {rnd('trust')}, fall > {dbl(0.2)} AS alert FROM steps JOIN ends USING (client_id, round)", recursive=True),
}

# continuing a stored history gives the history
ORACLES["trust_resumed"] = ORACLES["trust_adaptive"]
ORACLES["stream_resumed"] = ORACLES["stream_trust"]
ORACLES["history_repeated"] = with_(*HISTORY_CHAIN, final=f"SELECT client_id, round, {rnd('trust')}, event FROM history", recursive=True)
ORACLES["multi_round_weights"] = with_(
    VECTORS, CELLS, centroids("client_id, round"), scoring("client_id, round"), evaluation("scored_v", "client_id, round", "vm"),
    majority("vm", "client_id, round", "observed"), history(), LATEST, weights("latest", "", "weighted", "0.6"), QUOTAS,
    final=f"SELECT client_id, {rates_out(['trust', 'weight'])}, fallback, quota FROM demand", recursive=True)

EDGES = {"quantity": [10, 20, 30, 40], "extendedprice": [10000, 20000, 30000, 40000, 50000], "discount": [0.015, 0.035, 0.055, 0.075], "tax": [0.015, 0.035, 0.055]}
STUMP_BINS = "bins AS (" + " UNION ALL ".join(
    f"SELECT client_id, label, {i} AS feature, len(list_filter([{', '.join(f'{e}::DOUBLE' for e in edges)}], lambda e: e < {name})) AS bin, [{', '.join(f'{e}::DOUBLE' for e in edges)}] AS edges FROM flows"
    for i, (name, edges) in enumerate(EDGES.items())) + ")"


def gini(u: str, n: str) -> str:
    return f"(-2.0::DOUBLE * {u} * ({n} - {u}) / {n})"


ORACLES["source_stumps"] = with_(
    FLOWS, STUMP_BINS,
    "hist AS (SELECT client_id, feature, bin, any_value(edges) AS edges, CAST(sum(label) AS DOUBLE) AS u, CAST(count(*) AS DOUBLE) AS n FROM bins GROUP BY client_id, feature, bin)",
    """summed AS (SELECT client_id, feature, bin, edges, sum(u) OVER w AS lu, sum(n) OVER w AS ln, sum(u) OVER (PARTITION BY client_id, feature) AS au,
  sum(n) OVER (PARTITION BY client_id, feature) AS an FROM hist WINDOW w AS (PARTITION BY client_id, feature ORDER BY bin))""",
    f"""gains AS (SELECT *, CASE WHEN ln >= 4 AND an - ln >= 4 THEN {gini('lu', 'ln')} + {gini('(au - lu)', '(an - ln)')} - {gini('au', 'an')} END AS gain FROM summed)""",
    "best AS (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY CASE WHEN gain > 1e-9 THEN gain END DESC NULLS LAST, feature, bin) = 1)",
    "split AS (SELECT * FROM best WHERE gain > 1e-9)",
    """nodes AS (SELECT client_id, 0 AS level, 0 AS node, CASE WHEN gain > 1e-9 THEN feature END AS feature, CASE WHEN gain > 1e-9 THEN bin END AS bin,
    CASE WHEN gain > 1e-9 THEN edges[bin + 1] END AS threshold, CASE WHEN gain > 1e-9 THEN gain END AS gain, au AS u, an AS n FROM best
  UNION ALL SELECT client_id, 1, 0, NULL, NULL, NULL, NULL, lu, ln FROM split UNION ALL SELECT client_id, 1, 1, NULL, NULL, NULL, NULL, au - lu, an - ln FROM split)""",
    final=f"""SELECT client_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('level', 'node', 'feature', 'bin', 'n'))}, {rnd('threshold')}, {rnd('u / n', name='value')}, {rnd('gain')} FROM nodes""")
ORACLES["rebalance_texts"] = ORACLES["rebalance"]
ORACLES["scan_written"] = with_(FLOWS, final=f"""SELECT client_id, row_id,
  {rnd('CASE WHEN supplier % 2 = 0 THEN 0 ELSE discount END', name='discount')}, {rnd('CASE WHEN supplier % 2 = 0 THEN 0 ELSE extendedprice END', name='extendedprice')},
  {rnd('CASE WHEN supplier % 2 = 0 THEN quantity ELSE 0 END', name='quantity')}, {rnd('CASE WHEN supplier % 2 = 0 THEN tax ELSE 0 END', name='tax')} FROM flows""")
ORACLES["source_report"] = with_(FLOWS, split("flows"), final=f"""SELECT client_id, count(*) FILTER (split = 'train') AS train_samples,
  count(*) FILTER (split = 'val') AS val_samples, CAST(CASE WHEN any_value(supplier % 12) % 3 = 0 THEN 3 ELSE 4 END AS BIGINT) AS n_features,
  {rnd(ratio("count(*) FILTER (split = 'train' AND label = 0)", "count(*) FILTER (split = 'train')"), name='train_benign_ratio')},
  {rnd(ratio("count(*) FILTER (split = 'val' AND label = 0)", "count(*) FILTER (split = 'val')"), name='val_benign_ratio')} FROM splits GROUP BY 1""")
ORACLES["log_files"] = with_(*METRICS_CHAIN, LOGS, final=f"""SELECT client_id,
  {rnd("CASE WHEN CAST(regexp_extract(client_id, '([0-9]+)$', 1) AS INTEGER) % 2 = 1 THEN hi_accuracy ELSE mid_accuracy END", 4, 'table_row')},
  {rnd('mid_accuracy', 4, 'first_number')}, {rnd('mid_accuracy', 4, 'stored')} FROM logs""")
ORACLES["prepare_tiers"] = with_(
    *NOISY_CHAIN, """tc AS (SELECT client_id, quality, label, count(*) AS n,
  CASE quality WHEN 'high' THEN 25000 WHEN 'medium' THEN 5000 WHEN 'low' THEN 3000 ELSE 25000 END AS target FROM noisy GROUP BY ALL)""",
    shares("tc", "target"),
    """rc AS (SELECT client_id, quality, CAST(coalesce(sum(quota) FILTER (label = 0), 0) AS BIGINT) AS n0, CAST(coalesce(sum(quota) FILTER (label = 1), 0) AS BIGINT) AS n1
  FROM quotas GROUP BY ALL)""",
    "rb AS (SELECT *, (n0 + n1) // 2 AS half, quality = 'compromised' AND least(n0, n1) > 0 AND n0 <> n1 AND (n0 + n1) // 2 > least(n0, n1) AS moved FROM rc)",
    """bc AS (SELECT client_id, CASE WHEN NOT moved THEN n0 WHEN n0 > n1 THEN half ELSE n0 + least(half - n0, n0) END AS benign,
  CASE WHEN NOT moved THEN n1 WHEN n1 > n0 THEN half ELSE n1 + least(half - n1, n1) END AS attack FROM rb)""",
    final="SELECT client_id, benign + attack AS n, benign FROM bc")
ORACLES["trust_replayed"] = ORACLES["trust_adaptive"]
