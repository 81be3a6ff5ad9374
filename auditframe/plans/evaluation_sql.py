"""DuckDB SQL of the evaluation queries, written independently of the DataFrame plans."""

from __future__ import annotations

import re

SEED, N_BOOT = 20261009, 2000


def h(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % 1000000) / 1000000.0::DOUBLE"


def r(x: str, name: str) -> str:
    return f"floor(({x})::DOUBLE * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS {name}"


UNITS = f"""
u0 AS (SELECT concat_ws('#', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS uid, l_orderkey::VARCHAR AS image_id, 's/' || l_suppkey AS group_key,
  c_mktsegment AS site, CASE WHEN c_acctbal >= 0 THEN floor(5.0::DOUBLE + c_acctbal / 110.0::DOUBLE) END AS age,
  CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, l_returnflag AS flag, l_partkey AS part, l_linenumber AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
u1 AS (SELECT *, CASE WHEN {h("'lv:' || uid")} < 0.8 THEN 0 WHEN flag = 'N' THEN 0 WHEN flag = 'A' THEN 1 ELSE 2 END AS level FROM u0),
units AS (SELECT *, greatest(0.001::DOUBLE, least(0.999::DOUBLE, 0.15::DOUBLE + 0.2::DOUBLE * level + 0.5::DOUBLE * ({h("'sc:' || uid")} - 0.5::DOUBLE))) AS p_lesion FROM u1)"""
READINGS = f"""{UNITS},
readings AS (SELECT uid, image_id, group_key, rater, CASE WHEN {h("'ng:' || uid || ':' || rater")} < 0.15
  THEN floor({h("'nv:' || uid || ':' || rater")} * 1000000)::BIGINT % 3 ELSE level END::INT AS grade
  FROM units, (VALUES ('r1'), ('r2'), ('r3'), ('r4')) t(rater) WHERE {h("'ms:' || image_id || ':' || rater")} >= 0.2)"""
EVENTS = """ev AS (SELECT user_id::VARCHAR AS group_key, (event_type = 'error')::INT AS y,
  greatest(0.001::DOUBLE, least(0.999::DOUBLE, floor(value / 500.0::DOUBLE * 1000.0::DOUBLE) / 1000.0::DOUBLE)) AS p FROM events WHERE value IS NOT NULL)"""
IMAGES = """images AS (SELECT o_orderkey::VARCHAR AS image_id, 'c/' || o_custkey AS group_key, c_mktsegment AS site, (o_orderpriority = '1-URGENT')::INT AS urgent
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
CONTENT = "content AS (SELECT source AS subset, doc_id AS file, sha256(text) AS sha FROM documents)"
BOUNDS = "CASE WHEN m < 0.6::DOUBLE THEN 'train' WHEN m < 0.8::DOUBLE THEN 'val' ELSE 'test' END AS partition"
GROUP_SPLIT = f"""{IMAGES}, g AS (SELECT group_key, count(*) AS size, %s AS stratum FROM images GROUP BY 1),
gm AS (SELECT group_key, (sum(size) OVER (PARTITION BY stratum ORDER BY md5('{SEED}:' || group_key), group_key ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE)
  / sum(size) OVER (PARTITION BY stratum) AS m FROM g),
split AS (SELECT images.*, {BOUNDS} FROM images JOIN gm USING (group_key))"""
PATIENT_SPLIT = GROUP_SPLIT % "0"
NAIVE_SPLIT = f"""{IMAGES}, im AS (SELECT *, (row_number() OVER (ORDER BY md5('{SEED}:' || image_id), image_id) - 0.5::DOUBLE) / count(*) OVER () AS m FROM images),
split AS (SELECT image_id, group_key, site, urgent, {BOUNDS} FROM im)"""
SIZES = "SELECT partition, count(*) AS images, count(DISTINCT group_key) AS groups FROM split GROUP BY 1"
LEAK = f"""per AS (SELECT group_key, count(DISTINCT partition) AS k FROM split GROUP BY 1), per_image AS (SELECT image_id, count(*) AS k FROM split GROUP BY 1)
SELECT (SELECT count(*) FROM per) AS n_groups, (SELECT count(*) FILTER (k > 1) FROM per) AS leaked_groups,
  {r("(SELECT (count(*) FILTER (k > 1))::DOUBLE / count(*) FROM per)", "leaked_share")}, (SELECT count(*) FILTER (k > 1) FROM per_image) AS repeated_images, 0::BIGINT AS unverifiable_groups"""


def boot(ctes: str, rows: str, sums: dict[str, str], finals: dict[str, str], keys: list[str], seed: int = SEED, level: float = 0.95) -> str:
    """Estimates of additive statistics: ``rows`` has group_key, the keys and what ``sums`` need."""
    return f"""WITH {ctes}, {boot_parts(rows, sums, finals, keys, seed)}{ending(keys, level)}"""


def boot_parts(rows: str, sums: dict[str, str], finals: dict[str, str], keys: list[str], seed: int, p: str = "") -> str:
    ks = "".join(f"{k}, " for k in keys)
    by = f"GROUP BY {', '.join([*keys, 'b'])}"
    each = lambda extra: " UNION ALL ".join(f"SELECT {ks}{extra}'{n}' AS statistic, ({e})::DOUBLE AS v FROM {p}{'sm' if extra else 'tot'}" for n, e in finals.items())
    return f"""{p}base AS (SELECT * FROM {rows}),
{p}idx AS (SELECT group_key, row_number() OVER (ORDER BY group_key) - 1 AS g FROM (SELECT DISTINCT group_key FROM {p}base)),
{p}n AS (SELECT count(*) AS n FROM {p}idx),
{p}w AS (SELECT b, (('0x' || substr(md5('{seed}:' || b || ':' || slot), 1, 8))::BIGINT % n) AS g, count(*) AS w
  FROM {p}n, range({N_BOOT}) t(b), LATERAL (SELECT unnest(range(n)) AS slot) GROUP BY 1, 2),
{p}pg AS (SELECT {ks}group_key, {', '.join(f'sum({e})::BIGINT AS {n}' for n, e in sums.items())} FROM {p}base GROUP BY {ks}group_key),
{p}tot AS (SELECT {ks}{', '.join(f'sum({n})::DOUBLE AS {n}' for n in sums)} FROM {p}pg {'GROUP BY ' + ', '.join(keys) if keys else ''}),
{p}sm AS (SELECT {ks}b, {', '.join(f'sum(w * {n})::DOUBLE AS {n}' for n in sums)} FROM {p}pg JOIN {p}idx USING (group_key) JOIN {p}w USING (g) {by}),
{p}val AS ({each('')}), {p}smp AS ({each('b, ')})"""


def ending(keys: list[str], level: float, p: str = "") -> str:
    ks, a = "".join(f"{k}, " for k in keys), (1 - level) / 2
    using = ", ".join([*keys, "statistic"])
    return f""", {p}ci AS (SELECT {ks}statistic, quantile_cont(v, {a}) AS lo, quantile_cont(v, {1 - a}) AS hi, count(v) AS n_valid FROM {p}smp GROUP BY {using})
SELECT {ks}statistic, {r('v', 'value')}, {r('lo', 'lo')}, {r('hi', 'hi')}, coalesce(n_valid, 0) AS n_valid FROM {p}val LEFT JOIN {p}ci USING ({using})"""


DRAWS = f"""idx AS (SELECT group_key, row_number() OVER (ORDER BY group_key) - 1 AS g FROM (SELECT DISTINCT group_key FROM %s)), n AS (SELECT count(*) AS n FROM idx),
w AS (SELECT b, (('0x' || substr(md5('{SEED}:' || b || ':' || slot), 1, 8))::BIGINT %% n) AS g, count(*) AS w FROM n, range({N_BOOT}) t(b), LATERAL (SELECT unnest(range(n)) AS slot) GROUP BY 1, 2 UNION ALL SELECT -1, g, 1 FROM idx)"""
K = 3
CELLS = {f"c{i}{j}": f"(a = {i} AND b = {j})::INT" for i in range(K) for j in range(K)}


def kappa(weights: str, k: int = K) -> str:
    w = lambda i, j: {"none": float(i != j), "linear": abs(i - j) / (k - 1), "quadratic": ((i - j) / (k - 1)) ** 2}[weights]
    total = "(" + " + ".join(f"c{i}{j}" for i in range(k) for j in range(k)) + ")"
    row = ["(" + " + ".join(f"c{i}{j}" for j in range(k)) + ")" for i in range(k)]
    col = ["(" + " + ".join(f"c{i}{j}" for i in range(k)) + ")" for j in range(k)]
    off = [(i, j) for i in range(k) for j in range(k) if w(i, j)]
    o = " + ".join(f"{w(i, j)}::DOUBLE * c{i}{j}" for i, j in off)
    e = " + ".join(f"{w(i, j)}::DOUBLE * {row[i]} * {col[j]}" for i, j in off)
    return f"1.0::DOUBLE - ({o}) * {total} / nullif({e}, 0)"


PAIRS = f"{READINGS}, pairs AS (SELECT x.uid, x.group_key, x.rater AS rater_a, y.rater AS rater_b, x.grade AS a, y.grade AS b FROM readings x JOIN readings y ON x.uid = y.uid AND x.rater < y.rater)"
LOO = f"""{READINGS}, loo AS (SELECT x.uid, x.group_key, x.rater, x.grade, list_sort(list(y.grade)) AS gs FROM readings x JOIN readings y ON x.uid = y.uid AND x.rater <> y.rater
  GROUP BY ALL HAVING count(*) >= 2), loo2 AS (SELECT *, gs[((len(gs) - 1) // 2 + 1)::INT] AS loo FROM loo)"""
LOO_ROWS = f"""{LOO}, m AS (SELECT uid, (p_lesion >= 0.3)::INT AS m FROM units),
who AS (SELECT group_key, rater, grade AS b, 'ceiling' AS who, loo AS a FROM loo2 UNION ALL SELECT group_key, rater, grade, 'model', m FROM loo2 JOIN m USING (uid))"""
LEVEL_SUMS = {"n1": "(level = 1)::INT", "t1": "(level = 1 AND p_lesion >= 0.3)::INT", "n2": "(level = 2)::INT", "t2": "(level = 2 AND p_lesion >= 0.3)::INT", "n0": "(level = 0)::INT", "t0": "(level = 0 AND p_lesion < 0.3)::INT"}
LEVEL_FINALS = {
    "sensitivity_1": "t1 / nullif(n1, 0)", "sensitivity_2": "t2 / nullif(n2, 0)", "specificity": "t0 / nullif(n0, 0)", "sensitivity_pooled": "(t1 + t2) / nullif(n1 + n2, 0)",
    "depth_gap": "t2 / nullif(n2, 0) - t1 / nullif(n1, 0)", "accuracy_minus_sound": "(t0 + t1 + t2 - n0) / nullif(n0 + n1 + n2, 0)",
}
HEADS = f"""{UNITS}, heads AS (SELECT *, {h("'dp:' || uid")} < 0.1::DOUBLE + 0.3::DOUBLE * level AS called_deep, least(0.999::DOUBLE, p_lesion + 0.1::DOUBLE * ({h("'bh:' || uid")})) AS p_binary FROM units)"""
AGE = "CASE WHEN age < 18 THEN '<18' WHEN age < 35 THEN '18-34' WHEN age < 50 THEN '35-49' WHEN age < 65 THEN '50-64' WHEN age >= 65 THEN '65+' END"
SUB_FINALS = {k: LEVEL_FINALS[k] for k in ("sensitivity_pooled", "specificity")}
QBINS = """edges AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e FROM ev),
binned AS (SELECT y, p, len(list_filter(e, lambda x: x <= p)) AS bin FROM ev, edges)"""
UBINS = "binned AS (SELECT y, p, least(floor(p * 10), 9)::INT AS bin FROM ev)"
ECE = f"gaps AS (SELECT bin, abs(sum(p) - sum(y)) AS gap, count(*) AS n FROM binned GROUP BY 1) SELECT sum(n)::BIGINT AS n, {r('sum(gap) / sum(n)', 'ece')} FROM gaps"
DECIDE = f"{UNITS}, dec AS (SELECT uid, group_key, (level > 0)::INT AS y, floor(p_lesion * 1000.0::DOUBLE) / 1000.0::DOUBLE AS p FROM units)"
CURVE = f"""{DECIDE}, cf AS (SELECT floor(greatest(p, 1 - p) * 100.0::DOUBLE) / 100.0::DOUBLE AS confidence, ((p >= 0.5)::INT = y) AS correct FROM dec),
cc AS (SELECT confidence, count(*) AS n, count(*) FILTER (NOT correct) AS wrong FROM cf GROUP BY 1),
curve AS (SELECT confidence, (sum(n) OVER s)::DOUBLE / sum(n) OVER () AS coverage, (sum(wrong) OVER s)::DOUBLE / sum(n) OVER s AS risk FROM cc WINDOW s AS (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING))"""


def fit_sensitivity(rows: str, target: float, coverage: float) -> str:
    return f"""pos AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS k, count(*) OVER () AS n FROM {rows} WHERE y = 1),
thr AS (SELECT max(p) AS threshold FROM pos WHERE k >= ceil({target}::DOUBLE * n)),
dist AS (SELECT abs(p - threshold) AS d, row_number() OVER (ORDER BY abs(p - threshold)) AS k, count(*) OVER () AS n FROM {rows}, thr),
mar AS (SELECT min(d) AS margin FROM dist WHERE k >= ceil((1 - {coverage}::DOUBLE) * n))"""


def _alpha(metric: str) -> str:
    delta = {"nominal": "(x.a <> x.b)::INT", "interval": "(x.a - x.b) * (x.a - x.b)", "ordinal": """power((SELECT sum(nc) FROM marg WHERE c BETWEEN least(x.a, x.b) AND greatest(x.a, x.b))
  - ((SELECT nc FROM marg WHERE c = x.a) + (SELECT nc FROM marg WHERE c = x.b)) / 2.0, 2)"""}[metric]
    return f"""WITH {READINGS}, cnt AS (SELECT uid, grade, count(*) AS n FROM readings GROUP BY ALL), m AS (SELECT uid, sum(n) AS m FROM cnt GROUP BY 1 HAVING sum(n) >= 2),
bym AS (SELECT x.grade AS a, y.grade AS b, m, sum(x.n * (y.n - (x.grade = y.grade)::INT)) AS s FROM cnt x JOIN cnt y USING (uid) JOIN m USING (uid) GROUP BY ALL),
o AS (SELECT a, b, sum(s::DOUBLE / (m - 1)) AS o FROM bym GROUP BY ALL), marg AS (SELECT a AS c, sum(o) AS nc FROM o GROUP BY 1), n AS (SELECT sum(nc) AS n FROM marg),
grid AS (SELECT p.c AS a, q.c AS b, p.nc AS na, q.nc AS nb FROM marg p, marg q),
x AS (SELECT grid.*, coalesce(o.o, 0) AS o FROM grid LEFT JOIN o ON grid.a = o.a AND grid.b = o.b),
dl AS (SELECT x.*, {delta} AS delta FROM x)
SELECT {r("1 - (sum(o * delta) / max(n)) / (sum(na * nb * delta) / (max(n) * (max(n) - 1)))", "alpha")} FROM dl, n"""


def _cohen(weights: str) -> str:
    sums = ", ".join(f"sum({e})::DOUBLE AS {n}" for n, e in CELLS.items())
    return f"WITH {PAIRS}, c AS (SELECT rater_a, rater_b, count(*) AS n, {sums} FROM pairs GROUP BY 1, 2) SELECT rater_a, rater_b, n, {r(kappa(weights), 'kappa')} FROM c"


SEL = "n acc pos neg pos_acc neg_acc tp tn tp_acc tn_acc missed".split()
_acc, _hit = "abs(p - threshold) > margin", "p >= threshold"
SEL_SUMS = dict(zip(SEL, ["1", f"({_acc})::INT", "(y = 1)::INT", "(y = 0)::INT", f"(y = 1 AND {_acc})::INT", f"(y = 0 AND {_acc})::INT", f"(y = 1 AND {_hit})::INT", f"(y = 0 AND NOT {_hit})::INT", f"(y = 1 AND {_acc} AND {_hit})::INT", f"(y = 0 AND {_acc} AND NOT {_hit})::INT", f"(y = 1 AND {_acc} AND NOT {_hit})::INT"]))
SEL_FINALS = {"coverage": "acc / nullif(n, 0)", "sensitivity_accepted": "tp_acc / nullif(pos_acc, 0)", "specificity_accepted": "tn_acc / nullif(neg_acc, 0)", "missed_positive_rate": "missed / nullif(pos, 0)", "sensitivity": "tp / nullif(pos, 0)", "specificity": "tn / nullif(neg, 0)"}


def _difference(ctes: str, a: tuple, b: tuple, keys: list[str]) -> str:
    """a - b; each: (rows, sums, finals, seed)."""
    using = ", ".join([*keys, "statistic"])
    one = lambda x, p: boot_parts(x[0], x[1], x[2], keys, x[3], p)
    ks = "".join(f"{k}, " for k in keys)
    return f"""WITH {ctes}, {one(a, 'a_')}, {one(b, 'b_')},
val AS (SELECT {ks}statistic, a_val.v - b_val.v AS v FROM a_val JOIN b_val USING ({using})), smp AS (SELECT {ks}b, statistic, a_smp.v - b_smp.v AS v FROM a_smp JOIN b_smp USING ({using}, b)){ending(keys, 0.95)}"""


def named(sql: str, old: str, new: str) -> str:
    """Cells c00.. of a kappa under another name."""
    return re.sub(rf"\b{old}(\d\d)\b", rf"{new}\1", sql)


WIDE = f"""{READINGS}, wd AS (SELECT uid, group_key, {', '.join(f"max(grade) FILTER (rater = 'r{i}') AS g{i}" for i in range(1, 5))} FROM readings GROUP BY 1, 2),
rs AS ({' UNION ALL '.join(f"SELECT uid, group_key, 'r{i}' AS rater, g{i} AS b, " + ', '.join(f'g{j} AS o{n}' for n, j in enumerate(x for x in range(1, 5) if x != i)) + f' FROM wd WHERE g{i} IS NOT NULL' for i in range(1, 5))}),
rl AS (SELECT *, list_sort(list_filter([o0, o1, o2], lambda x: x IS NOT NULL)) AS gs FROM rs),
sw AS (SELECT rl.*, gs[((len(gs) - 1) // 2 + 1)::INT] AS loo, floor(p_lesion * 100.0::DOUBLE)::INT AS s, (p_lesion >= 0.3)::INT AS m FROM rl JOIN units USING (uid) WHERE len(gs) >= 2)"""


def against(name: str, value: str) -> dict[str, str]:
    return {f"{name}{i}{j}": f"coalesce(({value} = {i} AND b = {j})::INT, 0)" for i in range(K) for j in range(K)}


MVR_SUMS = {"n": "1"} | against("m", "m") | against("l", "loo") | against("p", "o0") | against("q", "o1") | against("z", "o2")
_k = {x: named(kappa("linear"), "c", x) for x in "mlpqzxy"}
MVR_FINALS = {"n": "n", "model": _k["m"], "ceiling": _k["l"], "individual": f"list_avg([{_k['p']}, {_k['q']}, {_k['z']}])", "difference": f"({_k['m']}) - ({_k['l']})"}
SWEEP = f"""{WIDE}, sc AS (SELECT rater, s, b, count(*) AS n FROM sw GROUP BY ALL), ab AS (SELECT t, rater, (s >= t)::INT AS a, b, n FROM sc, range(1, 100) q(t)),
ck AS (SELECT t::INT AS t, rater, {', '.join(f'sum({e} * n)::DOUBLE AS {x}' for x, e in CELLS.items())} FROM ab GROUP BY 1, 2), cu AS (SELECT t, avg({kappa('linear')}) AS kappa FROM ck GROUP BY 1),
tp AS (SELECT arg_max(t, kappa) AS t, max(kappa) AS kappa FROM (SELECT * FROM cu ORDER BY t)), best AS (SELECT min(cu.t) AS t, max(tp.kappa) AS kappa FROM cu, tp WHERE cu.kappa = tp.kappa),
sb AS (SELECT sw.*, (s >= 30)::INT AS x, (s >= best.t)::INT AS y FROM sw, best)"""
SWEEP_SUMS = against("l", "loo") | against("x", "x") | against("y", "y")
SWEEP_FINALS = {"ceiling": _k["l"], "at_operating": _k["x"], "at_best": _k["y"]}
#: Teeth: units by image and tooth, readers of the image, the worst grade or 0.
TEETH = f"""{READINGS}, ut AS (SELECT *, (part % 4 * 10 + 10 + (line - 1) % 8 + 1)::INT AS fdi FROM units), rd AS (SELECT DISTINCT image_id, rater FROM readings),
iv AS (SELECT image_id, fdi, max(floor(p_lesion * 1000.0::DOUBLE) / 1000.0::DOUBLE) AS p FROM ut GROUP BY 1, 2), pt AS (SELECT image_id, min(group_key) AS group_key FROM units GROUP BY 1),
gr AS (SELECT r.image_id, fdi, rater, max(grade) AS grade FROM readings r JOIN ut USING (uid) GROUP BY 1, 2, 3),
tr AS (SELECT iv.image_id, iv.fdi, rd.rater, 'ds/' || pt.group_key AS group_key, p, coalesce(gr.grade, 0)::INT AS grade FROM iv JOIN rd USING (image_id) JOIN pt USING (image_id) LEFT JOIN gr ON gr.image_id = iv.image_id AND gr.fdi = iv.fdi AND gr.rater = rd.rater),
an AS (SELECT r.image_id, rater, CASE WHEN grade = 1 THEN 'caries' ELSE 'deep_caries' END AS finding, fdi FROM readings r JOIN ut USING (uid) WHERE grade > 0)"""

ORACLES = {
    "tooth_ratings": f"WITH {TEETH} SELECT rater, grade, count(*) AS n FROM tr GROUP BY 1, 2",
    "image_ratings_from_records": f"WITH {TEETH}, i AS (SELECT image_id, rater, max(grade) AS grade FROM tr GROUP BY 1, 2) SELECT rater, grade, count(*) AS n FROM i GROUP BY 1, 2",
    "tooth_table": f"""WITH {TEETH}, c AS (SELECT image_id, fdi, any_value(group_key) AS group_key, any_value(p) AS p, list_sort(list(grade)) AS gs FROM tr GROUP BY 1, 2), t AS (SELECT *, gs[((len(gs) - 1) // 2 + 1)::INT] AS reference FROM c)
SELECT reference, count(*) AS n, count(DISTINCT group_key) AS groups, {r('avg(1 - (1 - p))', 'p')}, count(*) FILTER (1 - (1 - p) >= 0.3) AS called FROM t GROUP BY 1""",
    "tooth_table_of_reader": f"WITH {TEETH} SELECT grade AS reference, count(*) AS n FROM tr WHERE rater = 'r1' GROUP BY 1",
    "region_crosstab": f"""WITH {TEETH}, g AS (SELECT finding, CASE WHEN fdi % 10 <= 2 THEN 'incisor' WHEN fdi % 10 = 3 THEN 'canine' WHEN fdi % 10 <= 5 THEN 'premolar' ELSE 'molar' END AS region, count(*) AS n FROM an GROUP BY 1, 2)
SELECT finding, region, n, {r('n::DOUBLE / sum(n) OVER (PARTITION BY finding)', 'share')} FROM g""",
    "per_image": f"""WITH {TEETH}, x AS (SELECT 'findings' AS what, (SELECT count(*) FROM an WHERE an.image_id = i.image_id) AS n FROM (SELECT DISTINCT image_id FROM rd) i
UNION ALL SELECT 'teeth', (SELECT count(*) FROM iv WHERE iv.image_id = i.image_id) FROM (SELECT DISTINCT image_id FROM rd) i) SELECT what, quantile_cont(n, 0.5)::DOUBLE AS median, max(n)::INT AS largest, count(*) FILTER (n = 0) AS without FROM x GROUP BY 1""",
    "model_vs_readers": f"""WITH {WIDE}, {boot_parts('sw', MVR_SUMS, MVR_FINALS, ['rater'], SEED)}, es AS (SELECT * FROM (WITH q AS (SELECT rater, statistic, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM smp GROUP BY 1, 2) SELECT * FROM val LEFT JOIN q USING (rater, statistic))),
wi AS (SELECT rater, {', '.join(f"max(v) FILTER (statistic = '{x}') AS {x}" for x in MVR_FINALS)}, max(lo) FILTER (statistic = 'difference') AS lo, max(hi) FILTER (statistic = 'difference') AS hi FROM es GROUP BY 1)
SELECT rater, n::BIGINT AS n, {', '.join(r(x, x) for x in ('model', 'ceiling', 'individual', 'difference', 'lo', 'hi'))}, lo > 0 AS exceeds_ceiling, hi < 0 AS below_ceiling FROM wi""",
    "kappa_sweep_summary": f"""WITH {SWEEP}, {boot_parts('sb', SWEEP_SUMS, SWEEP_FINALS, ['rater'], SEED, 'k_')},
mv AS (SELECT -1 AS b, statistic, avg(v) AS v FROM k_val GROUP BY ALL UNION ALL SELECT b, statistic, avg(v) FROM k_smp GROUP BY ALL), mw AS (SELECT * FROM mv UNION ALL SELECT y.b, 'best_minus_operating', y.v - x.v FROM mv x JOIN mv y ON x.b = y.b AND x.statistic = 'at_operating' AND y.statistic = 'at_best'),
val AS (SELECT statistic, v FROM mw WHERE b < 0), smp AS (SELECT b, statistic, v FROM mw WHERE b >= 0), es AS (SELECT * FROM (WITH zz AS (SELECT 1){ending([], 0.95)}))
SELECT es.*, best.t AS best, best.kappa >= (SELECT lo FROM es WHERE statistic = 'ceiling') AS reaches_ceiling, (SELECT lo FROM es WHERE statistic = 'best_minus_operating') > 0 AS operating_costs_agreement FROM es, best""",
    "fleiss_ci": boot(f"{READINGS}, fl AS (SELECT uid, group_key, count(*) AS m, {', '.join(f'count(*) FILTER (grade = {i}) AS n{i}' for i in range(3))} FROM readings GROUP BY 1, 2 HAVING count(*) = 4)", "fl",
        {"units": "1", "same": "n0 * (n0 - 1) + n1 * (n1 - 1) + n2 * (n2 - 1)", "t0": "n0", "t1": "n1", "t2": "n2"},
        {"kappa": "(same / (units * 12) - (t0 * t0 + t1 * t1 + t2 * t2) / ((t0 + t1 + t2) * (t0 + t1 + t2))) / nullif(1 - (t0 * t0 + t1 * t1 + t2 * t2) / ((t0 + t1 + t2) * (t0 + t1 + t2)), 0)"}, []),
    "split_patient_sizes": f"WITH {PATIENT_SPLIT} {SIZES}",
    "split_naive_sizes": f"WITH {NAIVE_SPLIT} {SIZES}",
    "split_stratified": f"WITH {GROUP_SPLIT % 'max(urgent)'} SELECT partition, urgent, count(*) AS images FROM split GROUP BY 1, 2",
    "split_kfold": f"""WITH {IMAGES}, g AS (SELECT group_key, count(*) AS size FROM images GROUP BY 1), gm AS (SELECT group_key, (sum(size) OVER (ORDER BY md5('{SEED}:' || group_key), group_key ROWS UNBOUNDED PRECEDING)
  - size / 2.0::DOUBLE) / sum(size) OVER () AS m FROM g), f AS (SELECT *, CASE WHEN m < 0.2::DOUBLE THEN 'fold0' WHEN m < 0.4::DOUBLE THEN 'fold1' WHEN m < 0.6::DOUBLE THEN 'fold2' WHEN m < 0.8::DOUBLE THEN 'fold3' ELSE 'fold4' END AS fold FROM images JOIN gm USING (group_key))
SELECT fold, count(*) AS images, count(DISTINCT group_key) AS groups FROM f GROUP BY 1""",
    "split_kfold_stratified": f"""WITH {IMAGES}, g AS (SELECT group_key, count(*) AS size, max(urgent) AS stratum FROM images GROUP BY 1), gm AS (SELECT group_key, (sum(size) OVER (PARTITION BY stratum ORDER BY md5('{SEED}:' || group_key), group_key ROWS UNBOUNDED PRECEDING)
  - size / 2.0::DOUBLE) / sum(size) OVER (PARTITION BY stratum) AS m FROM g), f AS (SELECT *, CASE WHEN m < 0.2::DOUBLE THEN 'fold0' WHEN m < 0.4::DOUBLE THEN 'fold1' WHEN m < 0.6::DOUBLE THEN 'fold2' WHEN m < 0.8::DOUBLE THEN 'fold3' ELSE 'fold4' END AS fold FROM images JOIN gm USING (group_key))
SELECT fold, urgent, count(*) AS images, count(DISTINCT group_key) AS groups FROM f GROUP BY 1, 2""",
    "ece_interval": f"""WITH {EVENTS}, idx AS (SELECT group_key, row_number() OVER (ORDER BY group_key) - 1 AS g FROM (SELECT DISTINCT group_key FROM ev)), n AS (SELECT count(*) AS n FROM idx),
dr AS (SELECT b, (('0x' || substr(md5('{SEED}:' || b || ':' || slot), 1, 8))::BIGINT % n) AS g FROM n, range({N_BOOT}) t(b), LATERAL (SELECT unnest(range(n)) AS slot) UNION ALL SELECT -1, g FROM idx),
rw AS (SELECT b, p, y FROM dr JOIN idx USING (g) JOIN ev USING (group_key)), eg AS (SELECT b, list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM rw GROUP BY 1),
bv AS (SELECT b, p, count(*) AS n, sum(y) AS y FROM rw GROUP BY 1, 2), bn AS (SELECT b, len(list_filter(e, lambda x: x <= p)) AS bin, abs(sum(p * n) - sum(y)) AS gap, sum(n) AS n FROM bv JOIN eg USING (b) GROUP BY 1, 2),
ec AS (SELECT b, 'ece' AS statistic, sum(gap) / sum(n) AS v FROM bn GROUP BY 1), val AS (SELECT statistic, v FROM ec WHERE b < 0), smp AS (SELECT b, statistic, v FROM ec WHERE b >= 0){ending([], 0.95)}""",
    "noise_floor": f"""WITH ev AS (SELECT event_id, greatest(0.001::DOUBLE, least(0.999::DOUBLE, floor(value / 500.0::DOUBLE * 1000.0::DOUBLE) / 1000.0::DOUBLE)) AS p, 0 AS y FROM events WHERE value IS NOT NULL),
eg AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM ev), bn AS (SELECT event_id, p, len(list_filter(e, lambda x: x <= p)) AS bin FROM ev, eg),
gp AS (SELECT b, bin, abs(sum(p - ({h("'nf:1:' || b || ':' || event_id")} < p)::INT)) AS gap, count(*) AS n FROM bn, range(1000) t(b) GROUP BY 1, 2), ec AS (SELECT b, sum(gap) / sum(n) AS ece FROM gp GROUP BY 1) SELECT {r('quantile_cont(ece, 0.95)', 'floor')} FROM ec""",
    "recalibration": f"""WITH RECURSIVE {EVENTS}, d AS (SELECT ln(p / (1 - p)) AS x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM ev GROUP BY p), t AS (SELECT sum(n) AS n, sum(y) AS y FROM d),
it AS (SELECT 0 AS k, ln(y / (n - y)) AS a, 0.0::DOUBLE AS b FROM t UNION ALL SELECT k + 1, a + (s2 * r0 - s1 * r1) / (s0 * s2 - s1 * s1), b + (s0 * r1 - s1 * r0) / (s0 * s2 - s1 * s1) FROM (
  SELECT k, a, b, sum(n * mu * (1 - mu)) AS s0, sum(n * mu * (1 - mu) * x) AS s1, sum(n * mu * (1 - mu) * x * x) AS s2, sum(y - n * mu) AS r0, sum((y - n * mu) * x) AS r1 FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS mu FROM it, d WHERE k < 30) GROUP BY k, a, b))
SELECT {r('b', 'slope')}, {r('a', 'intercept')} FROM it WHERE k = 30""",
    "leakage_measured": f"WITH {NAIVE_SPLIT}, {LEAK}",
    "leakage_patient_clean": f"WITH {PATIENT_SPLIT}, {LEAK}",
    "site_holdout_sizes": f"WITH {IMAGES}, s AS (SELECT DISTINCT site AS holdout FROM images) SELECT holdout, CASE WHEN site = holdout THEN 'test' ELSE 'train' END AS partition, count(*) AS images, count(DISTINCT group_key) AS groups FROM images, s GROUP BY 1, 2",
    "test_seen_patient_rate": f"WITH {NAIVE_SPLIT} SELECT count(*) AS n_test, count(*) FILTER (group_key IN (SELECT group_key FROM split WHERE partition <> 'test')) AS n_seen FROM split WHERE partition = 'test'",
    "eligible_training": f"WITH {CONTENT}, held AS (SELECT * FROM content WHERE subset IN ('src0', 'src1')) SELECT subset AS group_key, count(*) AS n FROM content WHERE sha NOT IN (SELECT sha FROM held) AND subset NOT IN (SELECT subset FROM held) GROUP BY 1",
    "swap_sets": f"WITH {CONTENT} SELECT file, subset FROM content WHERE subset <> 'src0' ORDER BY {h(f"'{SEED}:' || file")}, file LIMIT 50",
    "ratings_long": f"WITH {READINGS} SELECT rater, grade, count(*) AS n FROM readings GROUP BY 1, 2",
    "image_ratings": f"WITH {READINGS}, i AS (SELECT image_id, rater, max(grade) AS grade FROM readings GROUP BY 1, 2) SELECT rater, grade, count(*) AS n FROM i GROUP BY 1, 2",
    "consensus": f"WITH {READINGS}, c AS (SELECT uid, count(*) AS n_raters, CASE WHEN count(*) >= 2 THEN quantile_disc(grade, 0.5) END AS q, list_sort(list(grade)) AS g FROM readings GROUP BY 1) SELECT n_raters, CASE WHEN n_raters >= 2 THEN g[((n_raters - 1) // 2 + 1)::INT] END AS grade, count(*) AS n FROM c GROUP BY 1, 2",
    "contingency": f"WITH {PAIRS}, g AS (SELECT DISTINCT rater_a, rater_b FROM pairs), k AS (SELECT range::INT AS a FROM range(3)), l AS (SELECT range::INT AS b FROM range(3)), c AS (SELECT rater_a, rater_b, a, b, count(*) AS n FROM pairs GROUP BY ALL) SELECT rater_a, rater_b, a, b, coalesce(n, 0) AS n FROM (SELECT * FROM g, k, l) LEFT JOIN c USING (rater_a, rater_b, a, b)",
    "kappa_two_raters": f"WITH c AS (SELECT count(*) AS n, {', '.join(f'(count(*) FILTER (quality = {i} AND 1 - toxic = {j}))::DOUBLE AS c{i}{j}' for i in range(2) for j in range(2))} FROM labels) SELECT n, {r(kappa('none', 2), 'kappa')} FROM c",
    "pairwise_kappa_ci": boot(f"{PAIRS}, pp AS (SELECT *, rater_a || '-' || rater_b AS pair FROM pairs)", "pp", CELLS, {"kappa": kappa("linear")}, ["pair"]),
    "fleiss": f"""WITH {READINGS}, cnt AS (SELECT uid, grade, count(*) AS n FROM readings GROUP BY ALL), full_ AS (SELECT uid, sum(n * n) AS sq FROM cnt GROUP BY 1 HAVING sum(n) = 4),
p AS (SELECT count(*) AS n_units, sum(sq - 4)::DOUBLE / (count(*) * 12) AS pi FROM full_), s AS (SELECT grade, sum(n) AS n FROM cnt WHERE uid IN (SELECT uid FROM full_) GROUP BY 1),
e AS (SELECT sum(n * n)::DOUBLE / (sum(n) * sum(n)) AS pe FROM s) SELECT n_units, {r('(pi - pe) / (1 - pe)', 'kappa')} FROM p, e""",
    "loo_ceiling": boot(LOO_ROWS, "who", CELLS, {"kappa": kappa("linear")}, ["rater", "who"]),
    "ceiling_difference": _difference(LOO_ROWS, ("who WHERE who = 'model'", CELLS, {"kappa": kappa("linear")}, SEED), ("who WHERE who = 'ceiling'", CELLS, {"kappa": kappa("linear")}, SEED), ["rater"]),
    "kappa_sweep": f"WITH {SWEEP} SELECT t, {r('kappa', 'kappa')} FROM cu",
    "stratified_report": boot(UNITS, "units", LEVEL_SUMS, LEVEL_FINALS, []),
    "boot_bonferroni": boot(UNITS, "units", LEVEL_SUMS, {"depth_gap": LEVEL_FINALS["depth_gap"]}, [], level=1 - 0.05 / 3),
    "boot_specificity_ci": boot(UNITS, "units", LEVEL_SUMS, {k: LEVEL_FINALS[k] for k in ("sensitivity_1", "sensitivity_2", "specificity")}, []),
    "subgroup_age": boot(f"{UNITS}, ua AS (SELECT *, {AGE} AS subgroup FROM units WHERE age IS NOT NULL)", "ua", LEVEL_SUMS, SUB_FINALS, ["subgroup"]),
    "subgroup_sex": boot(f"{UNITS}, us AS (SELECT *, sex AS subgroup FROM units)", "us", LEVEL_SUMS, SUB_FINALS, ["subgroup"]),
    "subgroup_cells": f"WITH {UNITS}, c AS (SELECT {AGE} AS value, count(*) AS n, count(DISTINCT group_key) AS groups, (count(*) FILTER (level > 0))::BIGINT AS lesions FROM units WHERE age IS NOT NULL GROUP BY 1) SELECT *, CASE WHEN groups < 2 THEN 'fewer than two patients' WHEN lesions = 0 THEN 'no lesions in this subgroup' END AS reason FROM c",
    "event_rate_ci": boot(EVENTS, "ev", {"n": "1", "y": "y", "f": "(p >= 0.5)::INT"}, {"error_rate": "y / nullif(n, 0)", "flag_rate": "f / nullif(n, 0)"}, []),
    "boot_diff_unpaired": _difference(UNITS, ("units WHERE site = 'BUILDING'", LEVEL_SUMS, {"specificity": LEVEL_FINALS["specificity"]}, SEED), ("units WHERE site = 'MACHINERY'", LEVEL_SUMS, {"specificity": LEVEL_FINALS["specificity"]}, SEED + 1), []),
    "auc_by_level": f"""WITH {UNITS}, x AS (SELECT lv AS level, level AS l, p_lesion AS s FROM units, (VALUES (1), (2)) t(lv) WHERE units.level = 0 OR units.level = lv),
rk AS (SELECT level, l, rank() OVER (PARTITION BY level ORDER BY s) + (count(*) OVER (PARTITION BY level, s) - 1) / 2.0 AS rk FROM x),
a AS (SELECT level, count(*) FILTER (l > 0) AS n_pos, count(*) FILTER (l = 0) AS n_neg, sum(rk) FILTER (l > 0) AS rs FROM rk GROUP BY 1)
SELECT level, n_pos, n_neg, {r('(rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)', 'auc')} FROM a""",
    "auc_interval": f"""WITH {UNITS}, {DRAWS % 'units'}, cn AS (SELECT group_key, floor(p_lesion * 100.0::DOUBLE)::INT AS s, level, count(*) AS n FROM units GROUP BY ALL),
cv AS (SELECT b, s, level, sum(w * n) AS n FROM cn JOIN idx USING (group_key) JOIN w USING (g) GROUP BY ALL), tt AS (SELECT b, level, sum(n) AS t FROM cv GROUP BY ALL),
sd AS (SELECT b, s, n, sum(n) OVER (PARTITION BY b ORDER BY s) AS upto FROM cv WHERE level = 0),
ps AS (SELECT c.b, c.level, c.n, coalesce(sd.upto, 0) AS upto, CASE WHEN sd.s = c.s THEN sd.n ELSE 0 END AS ties FROM (SELECT * FROM cv WHERE level > 0) c ASOF LEFT JOIN sd ON c.b = sd.b AND c.s >= sd.s),
wn AS (SELECT b, level, sum(n * (upto - ties / 2.0::DOUBLE)) AS wins FROM ps GROUP BY ALL),
au AS (SELECT wn.b, wn.level, wins / (p.t::DOUBLE * q.t::DOUBLE) AS v FROM wn JOIN tt p ON p.b = wn.b AND p.level = wn.level JOIN tt q ON q.b = wn.b AND q.level = 0),
st AS (SELECT b, 'auc_' || level AS statistic, v FROM au UNION ALL SELECT x.b, 'auc_gap', y.v - x.v FROM au x JOIN au y ON x.b = y.b AND x.level = 1 AND y.level = 2),
val AS (SELECT statistic, v FROM st WHERE b < 0), smp AS (SELECT * FROM st WHERE b >= 0){ending([], 0.95)}""",
    "depth_rates": boot(HEADS, "heads", {f"{c}_{k}": f"(level = {k} AND {test})::INT" for k in (1, 2) for c, test in (
        ("n", "true"), ("detected", "p_lesion >= 0.3"), ("correct", f"p_lesion >= 0.3 AND {'NOT' if k == 1 else ''} called_deep"), ("binary", "p_binary >= 0.3"))},
        {f"{c}_{k}": f"{c}_{k} / nullif(n_{k}, 0)" for k in (1, 2) for c in ("detected", "correct", "binary")} | {f"gain_{k}": f"binary_{k} / nullif(n_{k}, 0) - detected_{k} / nullif(n_{k}, 0)" for k in (1, 2)}, []),
    "missed_margins": f"""WITH {HEADS} SELECT count(*) AS n, count(*) FILTER (called_deep) AS called_deep, count(*) FILTER (p_lesion < 0.3) AS missed,
  {r('(count(*) FILTER (p_lesion < 0.3 AND p_lesion >= 0.15))::DOUBLE / nullif(count(*) FILTER (p_lesion < 0.3), 0)', 'just_below')}, {r('quantile_cont(p_lesion, 0.5) FILTER (p_lesion < 0.3)', 'median_missed')} FROM heads WHERE level = 2""",
    "krippendorff_ci": f"""WITH {READINGS}, cnt AS (SELECT uid, group_key, grade, count(*) AS n FROM readings GROUP BY ALL), m AS (SELECT uid, sum(n) AS m FROM cnt GROUP BY 1 HAVING sum(n) >= 2),
bym AS (SELECT x.group_key, x.grade AS a, y.grade AS b, m, sum(x.n * (y.n - (x.grade = y.grade)::INT)) AS s FROM cnt x JOIN cnt y USING (uid) JOIN m USING (uid) GROUP BY ALL),
{DRAWS % 'bym'},
o AS (SELECT w.b AS rs, bym.a, bym.b, sum(w * s::DOUBLE * 6 / (m - 1))::DOUBLE / 6 AS o FROM bym JOIN idx USING (group_key) JOIN w USING (g) GROUP BY ALL),
mg AS (SELECT rs, a AS c, sum(o) AS nc FROM o GROUP BY ALL), tot AS (SELECT rs, sum(nc) AS n FROM mg GROUP BY 1),
gr AS (SELECT p.rs, p.c AS a, q.c AS b, p.nc AS na, q.nc AS nb, (SELECT sum(nc) FROM mg z WHERE z.rs = p.rs AND z.c BETWEEN least(p.c, q.c) AND greatest(p.c, q.c)) - (p.nc + q.nc) / 2 AS between FROM mg p JOIN mg q ON p.rs = q.rs AND p.c <> q.c),
dl AS (SELECT gr.*, k.metric, CASE k.metric WHEN 'nominal' THEN 1.0::DOUBLE WHEN 'interval' THEN (a - b) * (a - b) ELSE between * between END AS delta FROM gr, (VALUES ('nominal'), ('ordinal'), ('interval')) k(metric)),
al AS (SELECT dl.rs, metric, 1 - (sum(coalesce(o.o, 0) * delta) / any_value(n)) / nullif(sum(na * nb * delta) / (any_value(n) * (any_value(n) - 1)), 0) AS v FROM dl LEFT JOIN o ON dl.rs = o.rs AND dl.a = o.a AND dl.b = o.b JOIN tot ON tot.rs = dl.rs GROUP BY ALL),
val AS (SELECT metric AS statistic, v FROM al WHERE rs < 0), smp AS (SELECT rs AS b, metric AS statistic, v FROM al WHERE rs >= 0){ending([], 0.95)}""",
    "brier": f"WITH {EVENTS} SELECT count(*) AS n, {r('avg((p - y) * (p - y))', 'brier')} FROM ev",
    "ece_uniform": f"WITH {EVENTS}, {UBINS}, {ECE}",
    "ece_quantile": f"WITH {EVENTS}, {QBINS}, {ECE}",
    "reliability_curve": f"WITH {EVENTS}, {QBINS} SELECT bin::INT AS bin, count(*) AS n, {r('avg(p)', 'mean_p')}, {r('avg(y)', 'rate')} FROM binned GROUP BY 1",
    "risk_coverage": f"WITH {CURVE} SELECT {r('confidence', 'confidence')}, {r('coverage', 'coverage')}, {r('risk', 'risk')} FROM curve",
    "aurc": f"WITH {CURVE}, ar AS (SELECT (coverage - coalesce(lag(coverage) OVER (ORDER BY confidence DESC), 0)) * risk AS area FROM curve) SELECT {r('sum(area)', 'aurc')} FROM ar",
    "operating_point_sens": f"WITH {DECIDE}, {fit_sensitivity('dec', 0.9, 0.85)} SELECT {r('threshold', 'threshold')}, false AS strict, {r("(SELECT (count(*) FILTER (p >= threshold))::DOUBLE / count(*) FROM pos)", 'fitted')}, {r('margin', 'margin')} FROM thr, mar",
    "operating_point_spec": f"WITH {DECIDE}, neg AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM dec WHERE y = 0), thr AS (SELECT min(p) AS threshold FROM neg WHERE k >= ceil(0.8::DOUBLE * n)) SELECT {r('threshold', 'threshold')}, true AS strict, {r("(SELECT (count(*) FILTER (p <= threshold))::DOUBLE / count(*) FROM neg)", 'fitted')}, NULL::DOUBLE AS margin FROM thr",
    "selective_eval": boot(f"{DECIDE}, odd AS (SELECT *, split_part(group_key, '/', 2)::BIGINT % 2 AS odd FROM dec), fit AS (SELECT * FROM odd WHERE odd = 0), {fit_sensitivity('fit', 0.9, 0.85)}, ev2 AS (SELECT * FROM odd, thr, mar WHERE odd = 1)", "ev2", SEL_SUMS, SEL_FINALS, []),
    "tripwire": f"WITH {UNITS}, t AS (SELECT site, level, count(*) AS n, avg((p_lesion >= 0.3)::INT) AS value FROM units WHERE level > 0 GROUP BY 1, 2) SELECT site, level, n, {r('value', 'value')}, CASE WHEN n < 20 THEN 'small cell' ELSE 'flag' END AS kind FROM t WHERE value > 0.95",
}
ORACLES |= {f"cohen_kappa_{w}": _cohen(w) for w in ("none", "linear", "quadratic")}
ORACLES |= {f"krippendorff_{m}": _alpha(m) for m in ("nominal", "ordinal", "interval")}
