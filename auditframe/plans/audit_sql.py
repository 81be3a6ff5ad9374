"""DuckDB SQL of the audit queries, written independently of the DataFrame plans."""

from __future__ import annotations

from auditframe.plans.evaluation_sql import CONTENT, EVENTS, N_BOOT, READINGS, SEED, UNITS, _difference, boot, boot_parts, ending, h, r

BOXES = f"""{UNITS},
les AS (SELECT image_id, group_key, uid AS lesion_id, level, (part % 50 * 8)::DOUBLE AS x1, (line * 40)::DOUBLE AS y1 FROM units WHERE level > 0),
det AS (SELECT image_id, group_key, uid AS det_id, floor(p_lesion * 1000.0::DOUBLE) / 1000.0::DOUBLE AS score,
  (part % 50 * 8)::DOUBLE + floor({h("'jx:' || uid")} * 20.0::DOUBLE) AS x1, (line * 40)::DOUBLE AS y1
  FROM units WHERE level > 0 OR {h("'bg:' || uid")} < 0.1),
ov0 AS (SELECT d.image_id, det_id, lesion_id, level, score,
  greatest(0, least(d.x1, l.x1) + 30 - greatest(d.x1, l.x1)) * greatest(0, least(d.y1, l.y1) + 30 - greatest(d.y1, l.y1)) AS inter FROM det d JOIN les l USING (image_id)),
ov AS (SELECT *, inter / (1800 - inter) AS iou FROM ov0 WHERE inter / (1800 - inter) >= 0.5)"""


def matching(name: str, ignored: str) -> str:
    return f"""{name}_pref AS (SELECT image_id, det_id, any_value(score) AS score, list(lesion_id ORDER BY {ignored}, -iou, lesion_id) AS choices FROM ov GROUP BY 1, 2),
{name}_lists AS (SELECT image_id, list(det_id ORDER BY -score, det_id) AS dets, list(choices ORDER BY -score, det_id) AS cands FROM {name}_pref GROUP BY 1),
{name}_taken AS (SELECT image_id, dets, list_reduce(cands, lambda acc, c: list_concat(acc, [coalesce(list_extract(list_filter(c, lambda x: NOT list_contains(acc, x)), 1), '')]), []::VARCHAR[]) AS got FROM {name}_lists),
{name} AS (SELECT det.*, nullif(t.lesion_id, '') AS lesion_id FROM det LEFT JOIN (SELECT image_id, unnest(dets) AS det_id, unnest(got) AS lesion_id FROM {name}_taken) t USING (image_id, det_id))"""


MATCH = f"{BOXES}, {matching('mt', '0')}"
AP = f"""rk AS (SELECT *, sum(tp) OVER (PARTITION BY k ORDER BY score DESC, det_id ROWS UNBOUNDED PRECEDING) AS hits, row_number() OVER (PARTITION BY k ORDER BY score DESC, det_id) AS rn FROM hit),
env AS (SELECT k, tp, max(hits::DOUBLE / rn) OVER (PARTITION BY k ORDER BY score DESC, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM rk)"""
TEETH = "((floor(y1 / 40)::INT % 4 + 1) * 10 + floor(x1 / 50)::INT % 8 + 1)"
#: Signatures and thumbs of whole texts; all pairs of documents, without any collapsing; the smallest document with each signature.
SIG = f"""wd AS (SELECT doc_id AS id, unnest(list_distinct(string_split(coalesce(text, ''), ' '))) AS word FROM documents),
hs AS (SELECT id, ('0x' || substr(md5(word), 1, 16))::UBIGINT AS h, ('0x' || substr(md5(word), 17, 2))::BIGINT % 32 AS place FROM wd),
sg AS (SELECT id, ({' + '.join(f"CASE WHEN 2 * sum(((h >> {i}::UBIGINT) & 1::UBIGINT)::BIGINT) > count(*) THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))})::UBIGINT AS sig,
  [{', '.join(f"(count(*) FILTER (place = {i}))::DOUBLE" for i in range(32))}] AS thumb FROM hs GROUP BY id),
rp AS (SELECT id, min(id) OVER (PARTITION BY sig, thumb) AS rep FROM sg)"""
NEAR = f"""{SIG}, np AS (SELECT x.id AS a, y.id AS b, x.thumb AS ta, y.thumb AS tb, bit_count(xor(x.sig, y.sig))::INT AS distance FROM sg x JOIN sg y ON x.id < y.id WHERE bit_count(xor(x.sig, y.sig)) <= 10),
nc AS (SELECT *, CASE WHEN ta = tb THEN 1.0::DOUBLE ELSE (list_dot_product(ta, tb) - list_sum(ta) * list_sum(tb) / 32) / nullif(sqrt((list_dot_product(ta, ta) - list_sum(ta) * list_sum(ta) / 32) * (list_dot_product(tb, tb) - list_sum(tb) * list_sum(tb) / 32)), 0) END AS correlation FROM np)"""
NEAR_ROWS = """SELECT a, b, distance FROM nc JOIN rp ra ON a = ra.id JOIN rp rb ON b = rb.id WHERE ra.rep = a AND rb.rep = b AND distance <= 6 AND {}
UNION ALL SELECT rep, id, 0 FROM rp WHERE id <> rep"""
COMPONENTS = f"""{NEAR}, lk AS (SELECT a, b FROM np WHERE distance <= 6 UNION SELECT b, a FROM np WHERE distance <= 6),
reach AS (SELECT a AS id, a AS label FROM lk UNION SELECT reach.id, lk.b FROM reach JOIN lk ON reach.label = lk.a),
labels AS (SELECT id, min(label) AS label FROM reach GROUP BY 1)"""
#: Contents by their first document; the subsets that hold a near copy of other bytes.
COPIES = """ct AS (SELECT source AS subset, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS id FROM documents), px AS (SELECT a, b FROM np WHERE distance <= 6 AND a IN (SELECT id FROM ct) AND b IN (SELECT id FROM ct)),
lk AS (SELECT DISTINCT z.a AS id, y.subset AS other FROM (SELECT a, b FROM px UNION ALL SELECT b, a FROM px) z JOIN ct y ON y.id = z.b)"""
R = "WITH RECURSIVE"
CHI = f"""tt AS (SELECT sum(p) AS hits, sum(m) AS total, count(*) AS k FROM t), cells AS (SELECT k, total, p AS o, m * hits::DOUBLE / total AS e FROM t, tt UNION ALL SELECT k, total, m - p, m * (total - hits)::DOUBLE / total FROM t, tt),
g AS (SELECT k, total, e, abs(o - e) - CASE WHEN k = 2 THEN least(0.5, abs(o - e)) ELSE 0 END AS gap FROM cells)
SELECT max(total)::BIGINT AS n, (max(k) - 1)::BIGINT AS df, {r('sum(gap * gap / e)', 'chi2')} FROM g"""

SHALLOW = {"n": "(level = 1)::INT", "t": "(level = 1 AND p_lesion >= 0.3)::INT"}

ORACLES = {
    "iou_pairs": f"WITH {BOXES} SELECT count(*) AS pairs, {r('avg(floor(iou * 1e6)::BIGINT) / 1e6', 'mean_iou')} FROM ov",
    "greedy_match": f"WITH {MATCH} SELECT image_id, det_id, lesion_id FROM mt WHERE lesion_id IS NOT NULL",
    "detection_sens": boot(f"{MATCH}, ls AS (SELECT les.group_key, level, (h.lesion_id IS NOT NULL) AS hit FROM les LEFT JOIN (SELECT image_id, lesion_id FROM mt WHERE score >= 0.3 AND lesion_id IS NOT NULL) h USING (image_id, lesion_id))", "ls",
        {"n1": "(level = 1)::INT", "t1": "(level = 1 AND hit)::INT", "n2": "(level = 2)::INT", "t2": "(level = 2 AND hit)::INT"}, {"sensitivity_1": "t1 / nullif(n1, 0)", "sensitivity_2": "t2 / nullif(n2, 0)"}, []),
    "fp_per_image": boot(f"{MATCH}, im AS (SELECT image_id, min(group_key) AS group_key FROM units GROUP BY 1), fpc AS (SELECT image_id, count(*) AS fp FROM mt WHERE lesion_id IS NULL AND score >= 0.3 GROUP BY 1), fi AS (SELECT group_key, coalesce(fp, 0) AS fp FROM im LEFT JOIN fpc USING (image_id))", "fi",
        {"fp": "fp", "n": "1"}, {"fp_per_image": "fp / nullif(n, 0)"}, []),
    "froc": f"""WITH {MATCH}, n AS (SELECT count(DISTINCT image_id) AS n FROM units), st AS (SELECT score, sum(count(*) FILTER (lesion_id IS NULL)) OVER (ORDER BY score DESC) AS fp FROM mt GROUP BY 1),
cut AS (SELECT fp_rate, min(score) AS threshold FROM (VALUES (0.05), (0.1), (0.2), (0.5)) q(fp_rate), n LEFT JOIN st ON fp::DOUBLE / n <= fp_rate GROUP BY 1),
sc AS (SELECT level, m.score FROM les LEFT JOIN (SELECT image_id, lesion_id, score FROM mt WHERE lesion_id IS NOT NULL) m USING (image_id, lesion_id))
SELECT level, fp_rate::DOUBLE AS fp_rate, {r('(count(*) FILTER (score >= threshold))::DOUBLE / count(*)', 'sensitivity')} FROM sc, cut GROUP BY 1, 2""",
    "ap_pooled": f"WITH {MATCH}, hit AS (SELECT 0 AS k, score, det_id, (lesion_id IS NOT NULL)::INT AS tp FROM mt), {AP} SELECT (SELECT count(*) FROM les) AS n_pos, {r('(SELECT sum(e) FROM env WHERE tp = 1) / (SELECT count(*) FROM les)', 'ap')}",
    "ap_interval": f"""WITH {MATCH}, idx AS (SELECT group_key, row_number() OVER (ORDER BY group_key) - 1 AS g FROM (SELECT group_key FROM det UNION SELECT group_key FROM les)), n AS (SELECT count(*) AS n FROM idx),
w AS (SELECT b, (('0x' || substr(md5('{SEED}:' || b || ':' || slot), 1, 8))::BIGINT % n) AS g, count(*) AS w FROM n, range({N_BOOT}) t(b), LATERAL (SELECT unnest(range(n)) AS slot) GROUP BY 1, 2 UNION ALL SELECT -1, g, 1 FROM idx),
cn AS (SELECT group_key, score, count(*) AS n, count(*) FILTER (lesion_id IS NOT NULL) AS hits FROM mt GROUP BY 1, 2), ps AS (SELECT group_key, count(*) AS n_pos FROM les GROUP BY 1),
cv AS (SELECT b, score, sum(w * n) AS n, sum(w * hits) AS hits FROM cn JOIN idx USING (group_key) JOIN w USING (g) GROUP BY 1, 2), tp AS (SELECT b, sum(w * n_pos) AS n_pos FROM ps JOIN idx USING (group_key) JOIN w USING (g) GROUP BY 1),
pr AS (SELECT b, score, hits, (sum(hits) OVER d)::DOUBLE / sum(n) OVER d AS precision FROM cv WINDOW d AS (PARTITION BY b ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
gn AS (SELECT b, sum(hits * e) AS gain FROM (SELECT b, hits, max(precision) OVER (PARTITION BY b ORDER BY score ROWS UNBOUNDED PRECEDING) AS e FROM pr) GROUP BY 1),
ap AS (SELECT b, coalesce(gain, 0) / nullif(n_pos, 0)::DOUBLE AS v FROM tp LEFT JOIN gn USING (b)), val AS (SELECT 'ap' AS statistic, v FROM ap WHERE b < 0), smp AS (SELECT b, 'ap' AS statistic, v FROM ap WHERE b >= 0){ending([], 0.95)}""",
    "ap_by_level": f"""WITH {BOXES}, {matching('m1', '(level <> 1)::INT')}, {matching('m2', '(level <> 2)::INT')},
hit AS (SELECT 1 AS k, score, det_id, (lesion_id IS NOT NULL)::INT AS tp FROM m1 LEFT JOIN les USING (image_id, lesion_id) WHERE level IS NULL OR level = 1
  UNION ALL SELECT 2, score, det_id, (lesion_id IS NOT NULL)::INT FROM m2 LEFT JOIN les USING (image_id, lesion_id) WHERE level IS NULL OR level = 2), {AP},
ps AS (SELECT level, count(*) AS n_pos FROM les GROUP BY 1), gn AS (SELECT k, sum(e) FILTER (tp = 1) AS gain FROM env GROUP BY 1)
SELECT level, n_pos, {r('coalesce(gain, 0) / n_pos', 'ap')} FROM ps LEFT JOIN gn ON level = k""",
    "enumeration_pr": f"""WITH {BOXES}, t AS (SELECT *, {TEETH} AS fdi FROM les), p AS (SELECT *, {TEETH} AS fdi FROM det), b AS (SELECT greatest(0, least(p.x1, t.x1) + 30 - greatest(p.x1, t.x1)) * greatest(0, least(p.y1, t.y1) + 30 - greatest(p.y1, t.y1)) AS inter FROM p JOIN t USING (image_id, fdi)),
c AS (SELECT (SELECT count(*) FROM les) AS n_true, (SELECT count(*) FROM det) AS n_pred, count(*) AS correct FROM b WHERE inter / (1800 - inter) >= 0.5)
SELECT n_true, n_pred, correct, {r('correct::DOUBLE / n_pred', 'precision')}, {r('correct::DOUBLE / n_true', 'recall')} FROM c""",
    "copy_effect": f"""WITH {BOXES}, im AS (SELECT image_id, min(group_key) AS group_key FROM units GROUP BY 1), t AS (SELECT *, {TEETH} AS fdi FROM les), p AS (SELECT *, {TEETH} AS fdi FROM det),
q AS (SELECT p.image_id, p.score, greatest(0, least(p.x1, t.x1) + 30 - greatest(p.x1, t.x1)) * greatest(0, least(p.y1, t.y1) + 30 - greatest(p.y1, t.y1)) AS inter FROM p JOIN t ON p.image_id = t.image_id AND p.fdi = t.fdi),
ct AS (SELECT image_id, group_key, (SELECT count(*) FROM t WHERE t.image_id = im.image_id) AS nt, (SELECT count(*) FROM p WHERE p.image_id = im.image_id) AS np, (SELECT count(*) FROM p WHERE p.image_id = im.image_id AND score >= 0.3) AS hp,
  (SELECT count(*) FROM q WHERE q.image_id = im.image_id AND inter / (1800 - inter) >= 0.5) AS nc, (SELECT count(*) FROM q WHERE q.image_id = im.image_id AND score >= 0.3 AND inter / (1800 - inter) >= 0.5) AS hc FROM im),
{boot_parts('ct', {c: c for c in ('nt', 'np', 'hp', 'nc', 'hc')}, {'precision': 'nc / nullif(np, 0) - hc / nullif(hp, 0)', 'recall': 'nc / nullif(nt, 0) - hc / nullif(nt, 0)'}, [], SEED)}{ending([], 0.95)}""",
    "tooth_inventory": f"WITH {BOXES}, b AS (SELECT image_id, {TEETH} AS fdi, max(score) AS score FROM det WHERE score >= 0.3 GROUP BY 1, 2) SELECT fdi::INT AS fdi, count(*) AS n, sum(floor(score * 1000 + 0.5)::BIGINT)::BIGINT AS score_sum FROM b GROUP BY 1",
    "content_overlap_matrix": f"WITH {CONTENT}, c AS (SELECT DISTINCT subset, sha FROM content) SELECT x.subset AS a, y.subset AS b, count(*) AS shared FROM c x JOIN c y ON x.sha = y.sha AND x.subset < y.subset GROUP BY 1, 2",
    "exact_elsewhere": f"WITH {CONTENT} SELECT subset, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM content y WHERE y.sha = x.sha AND y.subset <> x.subset)) AS elsewhere FROM content x GROUP BY 1",
    "within_subset_dups": f"WITH {CONTENT}, c AS (SELECT subset, sha, count(*) AS n FROM content GROUP BY 1, 2 HAVING count(*) > 1) SELECT subset, count(*) AS contents, sum(n)::BIGINT AS files FROM c GROUP BY 1",
    "near_pairs": f"WITH {NEAR} {NEAR_ROWS.format('true')}",
    "near_pairs_two_signals": f"WITH {NEAR} {NEAR_ROWS.format('correlation >= 0.95')}",
    "threshold_grid": f"WITH {NEAR} SELECT most::INT AS most, least::DOUBLE AS least, count(distance)::BIGINT AS n FROM (VALUES (0), (2), (4), (6), (8), (10)) g(most) CROSS JOIN (VALUES (0.8), (0.9), (0.95)) c(least) LEFT JOIN nc ON distance <= most AND correlation >= least GROUP BY 1, 2",
    "nn_cosine": """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), mn AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(v[i]) AS m FROM e, range(1, (SELECT max(len(v)) + 1 FROM e)) t(i) GROUP BY i)),
c AS (SELECT id, list_transform(range(1, len(v) + 1), lambda i: v[i] - m[i]) AS v FROM e, mn), p AS (SELECT x.id, max(list_cosine_similarity(x.v, y.v)) AS c FROM c x JOIN c y ON x.id <> y.id GROUP BY 1)
SELECT floor(c * 100.0::DOUBLE + 0.0000001::DOUBLE)::INT AS bin, count(*) AS n FROM p GROUP BY 1""",
    "reencoded_matrix": f"WITH {NEAR}, {COPIES} SELECT x.subset, other, count(DISTINCT x.id) AS n FROM ct x JOIN lk USING (id) GROUP BY 1, 2",
    "any_copy": f"""WITH {NEAR}, {COPIES}, u AS (SELECT DISTINCT subset, id FROM ct)
SELECT subset, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM ct y WHERE y.id = u.id AND y.subset <> u.subset) OR EXISTS (SELECT 1 FROM lk WHERE lk.id = u.id AND lk.other <> u.subset)) AS copies FROM u GROUP BY 1""",
    "crossing_pairs": f"WITH {NEAR}, nr AS ({NEAR_ROWS.format('true').split('UNION ALL')[0]}) SELECT a, b, x.source AS group_a, y.source AS group_b FROM nr JOIN documents x ON a = x.doc_id JOIN documents y ON b = y.doc_id WHERE x.source <> y.source",
    "partner_in_train": f"""{R} {COMPONENTS}, im AS (SELECT doc_id AS id, (row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id::VARCHAR) - 0.5) / count(*) OVER () AS m FROM documents),
pt AS (SELECT id, CASE WHEN m < 0.6 THEN 'train' WHEN m < 0.8 THEN 'val' ELSE 'test' END AS p FROM im)
SELECT count(*) AS n_test, count(*) FILTER (EXISTS (SELECT 1 FROM labels l JOIN labels k USING (label) JOIN pt q ON q.id = k.id WHERE l.id = pt.id AND q.p = 'train')) AS with_partner FROM pt WHERE p = 'test'""",
    "side_by_side": f"""WITH ls AS (SELECT sha256(text) AS id, source, string_agg(lang, ',' ORDER BY lang) AS l FROM documents WHERE source IN ('src1', 'src13') GROUP BY 1, 2)
SELECT x.id, coalesce(x.l, '') AS first, coalesce(y.l, '') AS second FROM ls x JOIN ls y ON x.id = y.id AND x.source = 'src1' AND y.source = 'src13'""",
    "training_sets": f"""WITH {CONTENT}, ix AS (SELECT file, sha, subset || '/' || file % 50 AS g FROM content), hd AS (SELECT * FROM ix WHERE g IN ('src0/1', 'src0/2', 'src0/3')), cd AS (SELECT * FROM ix WHERE g NOT IN ('src0/1', 'src0/2', 'src0/3')),
ho AS (SELECT file FROM cd WHERE sha NOT IN (SELECT sha FROM hd) AND g NOT IN (SELECT g FROM hd)), lk AS (SELECT file FROM cd WHERE sha IN (SELECT sha FROM hd)),
sw AS (SELECT file FROM (SELECT file, row_number() OVER (ORDER BY {h(f"'{SEED}:' || file")}, file) AS k FROM ho) WHERE k <= (SELECT count(*) FROM ho) - (SELECT count(*) FROM lk) UNION ALL SELECT file FROM lk)
SELECT 'honest' AS "set", count(*) AS n, sum(file)::BIGINT AS files FROM ho UNION ALL SELECT 'swap', count(*), sum(file)::BIGINT FROM sw UNION ALL SELECT 'naive', count(*), sum(file)::BIGINT FROM cd""",
    "prevalence_intervals": boot(f"{UNITS}, uc AS (SELECT *, site AS cluster FROM units)", "uc", {"n": "1", "y": "(level > 0)::INT"}, {"prevalence": "y / nullif(n, 0)"}, ["cluster"]),
    "recovered_groups": f"{R} {COMPONENTS} SELECT id, label FROM labels",
    "recovered_group_sizes": f"{R} {COMPONENTS}, s AS (SELECT label, count(*) AS size FROM labels GROUP BY 1) SELECT size, count(*) AS groups FROM s GROUP BY 1",
    "split_sensitivity": f"""{R} {COMPONENTS}, im AS (SELECT doc_id AS id, (row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id::VARCHAR) - 0.5) / count(*) OVER () AS m FROM documents),
pt AS (SELECT id, CASE WHEN m < 0.6 THEN 'train' WHEN m < 0.8 THEN 'val' ELSE 'test' END AS p FROM im), g AS (SELECT label, count(DISTINCT p) AS k FROM labels JOIN pt USING (id) GROUP BY 1)
SELECT count(*) AS groups, count(*) FILTER (k > 1) AS straddling FROM g""",
    "pair_quality": f"""WITH {NEAR}, d AS (SELECT a, b FROM np WHERE distance <= 6), t AS (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.doc_id < y.doc_id AND x.lang = y.lang),
c AS (SELECT (SELECT count(*) FROM d) AS n_declared, (SELECT count(*) FROM t) AS n_true, (SELECT count(*) FROM (SELECT * FROM d INTERSECT SELECT * FROM t)) AS "both")
SELECT n_declared, n_true, "both", {r('"both"::DOUBLE / nullif(n_declared, 0)', 'precision')}, {r('"both"::DOUBLE / nullif(n_true, 0)', 'recall')} FROM c""",
    "prevalence_by_cluster": f"WITH {UNITS} SELECT site, count(*) AS n, {r('avg((level > 0)::INT)', 'prevalence')} FROM units GROUP BY 1",
    "chi2_stat": f"WITH {UNITS}, t AS (SELECT site, count(*) FILTER (level > 0) AS p, count(*) AS m FROM units GROUP BY 1), {CHI}",
    "chi2_yates": f"WITH {UNITS}, t AS (SELECT sex, count(*) FILTER (level > 0) AS p, count(*) AS m FROM units GROUP BY 1), {CHI}",
    "mann_whitney_u": f"""WITH {EVENTS}, rk AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM ev), ti AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM ev GROUP BY p)),
s AS (SELECT (count(*) FILTER (y = 1))::DOUBLE AS n1, (count(*) FILTER (y = 0))::DOUBLE AS n2, sum(rk) FILTER (y = 1) - (count(*) FILTER (y = 1)) * ((count(*) FILTER (y = 1)) + 1) / 2.0 AS u FROM rk)
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, {r('u', 'u')}, {r('(abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))))', 'z')} FROM s, ti""",
    "summary_counts": f"""WITH {READINGS}, im AS (SELECT image_id, min(site) AS site, min(group_key) AS pt FROM units GROUP BY 1), rd AS (SELECT image_id, count(DISTINCT rater) AS k FROM readings GROUP BY 1),
rec AS (SELECT * FROM im JOIN rd USING (image_id)), an AS (SELECT CASE WHEN grade = 1 THEN 'caries' ELSE 'deep_caries' END AS finding, CASE WHEN grade = 1 THEN '1' ELSE '4' END AS stage, count(*) AS c FROM readings WHERE grade > 0 GROUP BY 1, 2)
SELECT (SELECT count(*) FROM rec) AS n_images, (SELECT sum(c) FROM an)::BIGINT AS n_annotations, (SELECT count(*) FILTER (k > 1) FROM rec) AS n_multi_reader, (SELECT count(DISTINCT pt) FROM rec) AS n_patients,
(SELECT max(c) FROM (SELECT count(*) AS c FROM rec GROUP BY pt)) AS max_images, {r('(SELECT count(*)::DOUBLE / count(DISTINCT pt) FROM rec)', 'images_per_patient')}, (SELECT '{{' || string_agg('"' || site || '":' || c, ',' ORDER BY site) || '}}' FROM (SELECT site, count(*) AS c FROM rec GROUP BY 1)) AS by_site_id,
(SELECT '{{' || string_agg('"' || finding || '":' || c, ',' ORDER BY finding) || '}}' FROM an) AS by_finding, (SELECT '{{' || string_agg('"' || stage || '":' || c, ',' ORDER BY stage) || '}}' FROM an) AS by_stage,
(SELECT '{{"provided":' || count(*) || '}}' FROM rec) AS by_id_source, (SELECT '{{"none":' || count(*) || '}}' FROM rec) AS by_inventory""",
    "record_round_trip": f"WITH {READINGS} SELECT count(DISTINCT image_id) AS n, count(DISTINCT image_id) AS unchanged FROM readings",
    "findings_by_reader": f"WITH {READINGS} SELECT rater AS annotator_id, CASE WHEN grade = 1 THEN 'caries' ELSE 'deep_caries' END AS finding, count(*) AS n FROM readings WHERE grade > 0 GROUP BY 1, 2",
    "constraint_counts": "SELECT unnest(['box', 'annotator', 'tooth', 'confidence', 'stage', 'inventory_source', 'identity', 'stray_annotator', 'inventory', 'age', 'size']) AS name, 0::BIGINT AS n",
    "label_mapping_classify": "SELECT target, count(*) AS n FROM (SELECT 'small_b1' AS target FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size % 5 IN (0, 1) UNION ALL SELECT 'any_large' FROM part WHERE p_size % 5 = 4) GROUP BY 1",
    "tooth_numbers": "SELECT (q * 10 + t)::INT AS fdi, ((CASE q WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 ELSE 3 END) * 10 + t)::INT AS mirrored, ((q - 1) * 8 + t)::INT AS label, (q * 10 + t)::INT AS back FROM range(1, 5) a(q), range(1, 9) b(t)",
    "domain_shift_delta": "SELECT 'caries' AS target, * FROM (" + _difference(UNITS, ("units WHERE site = 'BUILDING'", SHALLOW, {"sensitivity": "t / nullif(n, 0)"}, SEED), ("units WHERE site = 'MACHINERY'", SHALLOW, {"sensitivity": "t / nullif(n, 0)"}, SEED + 1), []) + ")",
    "not_computable_ledger": f"""WITH {UNITS}, c AS (SELECT site || '/' || part % 97 AS cell, count(*) FILTER (level = 1) AS n1, count(*) FILTER (level = 2) AS n2, count(DISTINCT group_key) AS groups, count(age) AS ages FROM units GROUP BY 1)
SELECT cell, 'sensitivity_1' AS metric, 'no lesion of this level' AS reason FROM c WHERE n1 = 0 UNION ALL SELECT cell, 'sensitivity_2', 'no lesion of this level' FROM c WHERE n2 = 0
UNION ALL SELECT cell, 'interval', 'fewer than two patients' FROM c WHERE groups < 2 UNION ALL SELECT cell, 'subgroup_age', 'no age on any unit' FROM c WHERE ages = 0""",
}
