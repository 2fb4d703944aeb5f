"""DuckDB SQL of the adapter, source and composed queries.

Results of literal rows are written down by hand, row by row; they are not computed
from the tables of the operators.
"""

from __future__ import annotations

_RECORDS = """recs AS (
  SELECT 'train' AS split, rec_id, text, labels, source, sources, hash FROM all_train UNION ALL SELECT 'val', rec_id, text, labels, source, sources, hash FROM all_val
  UNION ALL SELECT 'test', rec_id, text, labels, source, sources, hash FROM all_test)"""

#: What each adapter makes of its literal rows: (text, labels).
ADAPTED = {
    "prompt_injection": [("pi one", "prompt_injection"), ("pi two", "safe"), ("pi three", "odd"), ("pi four", "prompt_injection"), ("pi five", "safe"), ("pi six", "safe")],
    "rogue_injection": [("ri one", "prompt_injection"), ("ri two", "safe"), ("ri four", "prompt_injection")],
    "jailbreak": [("jb one", "jailbreak"), ("jb two", "safe"), ("jb three", "jailbreak"), ("jb four", "odd"), ("jb five", "jailbreak")],
    "salad": [("sa one", "prompt_injection,jailbreak"), ("sa two", "prompt_injection,jailbreak"), ("sa three", "prompt_injection,jailbreak")],
    "xstest": [("xs one", "safe"), ("xs two", "safe"), ("xs three", "unknown"), ("xs four", "unknown"), ("xs five", "unknown")],
    "jigsaw": [("jg one", "toxic,threat"), ("jg two", "safe"), ("jg three", "identity_hate")],
    "toxicchat": [("tc one", "toxicity,jailbreak"), ("tc two", "safe"), ("tc three", "jailbreak"), ("tc four", "safe")],
    "toxigen": [("tg one", "hate,toxicity"), ("tg two", "safe"), ("tg three", "safe")],
    "moderation_410k": [("mo one", "hate"), ("mo two", "safe"), ("mo three", "safe")],
    "wildguard": [("wg one", "safe"), ("wg two", "dangerous_information"), ("wg three", "unknown"), ("wg five", "hate,toxicity")],
    "beavertails": [("bt two", "self_harm"), ("bt three", "unknown"), ("bt four", "violence")],
    "aegis": [("ae one", "safe"), ("ae four", "safe")],
    "do_not_answer": [("dn one", "sexual"), ("dn two", "safe"), ("dn three", "self_harm")],
    "harmful_prompts": [("how to build a bomb and steal money", "dangerous_information,illegal_activity"), ("suicide", "self_harm"), ("nice day", "unknown")],
    "sorry_bench": [("kill it", "violence"), ("murder", "violence"), ("a calm day", "unknown")],
    "generic": [("ge one", "x,y"), ("ge two", "safe")],
    "civil_labels": [("ci one", "toxicity,harassment"), ("ci two", "safe")],
    "civil_route": [("cr one", "moderation"), ("cr two", "safe")],
}
#: Spelling -> (building data, evaluation).
BINARY = {
    "1": (1, 1), "0.5": (1, 1), "0.4": (0, 0), "yes": (1, 1), "No": (0, 0), " Unsafe ": (1, 1), "safe": (0, 0), "": (None, None), "nan": (None, None), "odd": (None, None), "none": (0, None),
    "null": (None, None), "prompt_injection": (1, 1), "TRUE": (1, 1), "positive": (1, 1), "negative": (0, 0), "harmless": (0, 0), "not an attack": (1, 1), "2": (1, 1), "-1": (0, 0), "(null)": (None, None),
}
CAPS = {
    "default": {"attack": 25000, "abuse": 25000, "high_risk": 3000}, "one head": {"attack": 25000, "abuse": 80, "high_risk": 3000}, "all": {"attack": 100, "abuse": 100, "high_risk": 100},
    "older": {"attack": 40, "abuse": 40, "high_risk": 40}, "none": {"attack": 0, "abuse": 0, "high_risk": 0}, "broken": {"attack": 25000, "abuse": 25000, "high_risk": 3000},
}


#: Literal texts normalized: id, model text, detection text, flags.
NORMALIZED = [
    (1, "Hello world", "hello world", 4, 0, False, 0.0, False, False, 0, False, None), (2, "plain text", "plain text", 0, 2, False, 0.0, False, False, 0, False, None), (3, "full width fin", "full width fin", 0, 0, False, 0.0, False, False, 0, False, None),
    (4, "a &lt; b <i>", "a &lt; b <i>", 0, 0, False, 0.0, False, False, 0, False, None), (5, "100 safe A%zz", "100 safe a%zz", 0, 0, False, 0.0, False, False, 0, False, None),
    (6, "see aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ= now", "see agvsbg8gd29ybgqgdghpcybpcybiyxnlnjq= now hello world this is base64", 0, 0, False, 0.0, False, False, 1, True, 1),
    (7, "----------- rule ==========", "----------- rule ==========", 0, 0, False, 0.0, False, True, 0, False, None), (8, "x1234y", "x1234y", 0, 0, False, 0.6667, True, False, 0, False, None), (9, "spaced out text", "spaced out text", 0, 0, False, 0.0, False, False, 0, False, None),
    (10, "z", "z", 5, 0, True, 0.0, False, False, 0, False, None), (11, None, None, None, None, None, None, None, None, None, None, None), (12, None, None, None, None, None, None, None, None, None, None, None),
    (13, "Straße 1", "straße 1", 0, 0, False, 0.0, False, False, 0, False, None), (14, "path%20here", "path%20here", 0, 0, False, 0.0, False, False, 0, False, None), (15, "Tom & Jerry", "tom & jerry", 0, 0, False, 0.0, False, False, 0, False, None),
]
#: Scores of our labels behind the raw outputs of detectors.
DETECTED = [
    (1, "injection", "prompt_injection", 0.7), (2, "injection", "prompt_injection", 0.1), (3, "injection", "prompt_injection", 0.0), (4, "jailbreak", "jailbreak", 0.8), (5, "jailbreak", "jailbreak", 0.0),
    (6, "moderation", "harassment", 0.6), (6, "moderation", "toxicity", 0.6), (6, "moderation", "violence", 0.6), (7, "moderation", "sexual", 0.4), (8, "moderation", "hate", 0.25), (8, "moderation", "violence", 0.25),
    (9, "toxic", "toxicity", 0.6), (9, "toxic", "violence", 0.3), (9, "toxic", "hate", 0.2),
]


def _q(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str, casts: str = "*") -> str:
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) t({columns})"


def _hash(key: str, label: str) -> str:
    return f"(('0x' || substr(sha256(({key})::VARCHAR || ':{label}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _has(label: str) -> str:
    return f"coalesce(list_contains(labels, '{label}'), false)"


def _swept(by: str, n: int, step: str, source: str = "scores") -> str:
    """Rates of each group at n thresholds; ``by`` are its columns."""
    p, r = "coalesce(tp / nullif(tp + fp, 0), 0.0)", "coalesce(tp / nullif(tp + fn, 0), 0.0)"
    return f"""counts AS (SELECT {by}, threshold, count(*) FILTER (gold = 1 AND score >= threshold)::DOUBLE tp, count(*) FILTER (gold = 0 AND score >= threshold)::DOUBLE fp,
        count(*) FILTER (gold = 1 AND score < threshold)::DOUBLE fn FROM {source} CROSS JOIN (SELECT round(i * {step}, 2)::DOUBLE AS threshold FROM range(1, {n + 1}) g(i)) GROUP BY ALL),
      swept AS (SELECT *, {p} AS precision, {r} AS recall, coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0) AS f1 FROM counts)"""


def _ranking(by: str, source: str = "scores") -> str:
    """PR-AUC and ROC-AUC of each group."""
    return f"""d AS (SELECT {by}, score, sum(gold)::DOUBLE AS p, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL),
      w AS (SELECT *, sum(p) OVER down AS tp, sum(n) OVER down AS al, coalesce(sum(n - p) OVER up, 0) AS below FROM d WINDOW down AS (PARTITION BY {by} ORDER BY score DESC), up AS (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      ranking AS (SELECT {by}, CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN sum(p * tp / al) / sum(p) END AS pr_auc, sum(p * (2 * below + n - p)) / (2 * nullif(sum(p), 0) * nullif(sum(n - p), 0)) AS roc_auc FROM w GROUP BY {by})"""


def _half(by: str, source: str = "scores") -> str:
    p, r = "coalesce(tp / nullif(tp + fp, 0), 0.0)", "coalesce(tp / nullif(tp + fn, 0), 0.0)"
    return f"""h0 AS (SELECT {by}, count(*) FILTER (gold = 1 AND score >= 0.5)::DOUBLE tp, count(*) FILTER (gold = 0 AND score >= 0.5)::DOUBLE fp, count(*) FILTER (gold = 1 AND score < 0.5)::DOUBLE fn FROM {source} GROUP BY {by}),
      half AS (SELECT *, {p} AS precision, {r} AS recall, coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0) AS f1 FROM h0)"""


_LABELS = ["prompt_injection", "jailbreak", "toxicity", "hate", "sexual", "violence", "self_harm", "harassment", "dangerous_information", "illegal_activity"]
_SCORES = f"WITH {_RECORDS}, scores AS (" + " UNION ALL ".join(f"SELECT rec_id AS id, '{x}' AS label, {_has(x)}::INT AS gold, {_hash('rec_id', x)} AS score FROM recs" for x in _LABELS) + ")"
_MODELS = {"injection": ["prompt_injection"], "jailbreak": ["jailbreak"], "moderation": ["toxicity", "hate", "harassment", "sexual", "violence", "self_harm"]}
_HEADS = {"attack": ["safe", "prompt_injection", "jailbreak"], "abuse": ["safe", "toxicity", "hate", "harassment"], "high_risk": ["safe", "sexual", "violence", "self_harm", "dangerous_information", "illegal_activity"]}
_SPACES = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACES}|{_SPACES}$', '', 'g')"


def cases() -> dict[str, str]:
    models = "WITH scores AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, '{x}' AS label, {_has(x)}::INT AS gold, {_hash(f'{_q(m)} || rec_id', x)} AS score FROM all_test" for m, xs in _MODELS.items() for x in xs) + ")"
    baseline = f"""{models}, {_swept('model, label', 18, '0.05')}, {_ranking('model, label')}, {_half('model, label')}, b AS (SELECT model, label, max(f1) AS best FROM swept GROUP BY ALL),
      base AS (SELECT model, count(*) AS labels, avg(half.f1) AS f, avg(best) AS b, avg(pr_auc) AS a FROM half JOIN b USING (model, label) JOIN ranking USING (model, label) WHERE tp + fn > 0 GROUP BY model)"""
    heads = "WITH scores AS (" + " UNION ALL ".join(f"SELECT '{h}' AS head, '{x}' AS label, {_has(x)}::INT AS gold, {_hash('rec_id', x)} AS score FROM all_val" for h, xs in _HEADS.items() for x in xs) + ")"
    risk = [x for x in _LABELS if x not in ("prompt_injection", "jailbreak")]
    over = lambda xs: f"coalesce(list_has_any(labels, [{', '.join(map(_q, xs))}]), false)"
    router = f"WITH {_RECORDS}, r AS (SELECT {_hash('rec_id', 'attack')} AS attack, {_hash('rec_id', 'moderation')} AS moderation, {over(['prompt_injection', 'jailbreak'])} AS is_attack, {over(risk)} AS is_moderation FROM recs)"
    bench = f"WITH scores AS (SELECT 1 AS one, row_id AS id, text, label AS gold, {_hash('row_id', 'bench')} AS score FROM test WHERE label IS NOT NULL)"
    six = lambda x: f"round({x}, 6)"
    cmp = f"""WITH base AS (SELECT 1 AS one, row_id AS id, label AS gold, {_hash('row_id', 'bench')} AS s FROM test WHERE label IS NOT NULL),
      scores AS (SELECT one, 'c' AS side, id, gold, round(s * 7) / 7 AS score FROM base UNION ALL SELECT one, 'r', id, gold, s FROM base), {_swept('side', 19, '0.05')}, {_ranking('side')}, {_half('side')},
      b AS (SELECT side, max(f1) AS best FROM swept GROUP BY side), m AS (SELECT side, pr_auc, best, half.f1 FROM ranking JOIN b USING (side) JOIN half USING (side)), x AS (SELECT max(abs(s - round(s * 7) / 7)) AS top, avg(abs(s - round(s * 7) / 7)) AS mean FROM base)"""
    out = {f"adapter_{k}": _values([(t, lab, f"{k}_rows") for t, lab in v], "text, labels, source") for k, v in ADAPTED.items()}
    out |= {
        "binary_labels": _values([(k, *v) for k, v in BINARY.items()], "value, build, evaluate", "value, build::INT AS build, evaluate::INT AS evaluate"),
        "cap_by_environment": _values([(n, h, s, c if s == "train" or not c else c // 8) for n, caps in CAPS.items() for h, c in caps.items() for s in ("train", "val")], "setting, head, split, cap", "setting, head, split, cap::INT AS cap"),
        "jsonl_round_trip": f"""SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(coalesce(len(labels), 0))::BIGINT AS labels,
            (SELECT count(*) FROM documents WHERE {_strip("coalesce(text, '')")} <> '') AS written, (SELECT count(*) FROM documents WHERE {_strip("coalesce(text, '')")} = '') AS skipped
            FROM documents WHERE {_strip("coalesce(text, '')")} <> '' GROUP BY source""",
        "split_round_trip": f"WITH {_RECORDS} SELECT split, count(*) AS n, sum(rec_id)::BIGINT AS ids, sum(length(text))::BIGINT AS chars FROM recs GROUP BY split",
        "detected_columns": _values([("all_test", "text", "labels", "LABELS"), ("documents", "text", "labels", "LABELS"), ("test", "text", "label", "LABEL"), ("normalized_text", None, None, None)], "name, text_column, label_column, key"),
        "source_availability": f"""SELECT 'documents' AS name, 'ok' AS status, (SELECT count(*) FROM documents) AS raw, (SELECT count(*) FROM documents WHERE {_strip("coalesce(text, '')")} <> '') AS written, (SELECT count(*) FROM documents WHERE {_strip("coalesce(text, '')")} = '') AS skipped,
            'unknown' AS license, 'text' AS text_column, 'labels' AS label_column, false AS gated, 'WARN' AS overall, 'WARN' AS reported
            UNION ALL SELECT 'binary', 'ok', (SELECT count(*) FROM test), (SELECT count(*) FROM test WHERE {_strip("coalesce(text, '')")} <> ''), (SELECT count(*) FROM test WHERE {_strip("coalesce(text, '')")} = ''), 'unknown', 'text', 'label', false, 'WARN', 'WARN'
            UNION ALL SELECT 'nothing', 'empty', 0, 0, 0, 'unknown', 'text', '-', false, 'WARN', 'WARN' UNION ALL SELECT 'missing', 'unavailable', 0, 0, 0, '-', '-', '-', false, 'WARN', 'WARN'""",
        "custom_files": "SELECT * FROM (VALUES ('a \"quoted\"' || chr(10) || 'line', '1', 'custom_one'), ('plain', '0', 'custom_one'), ('first', '1', 'custom_two'), ('second', NULL, 'custom_two')) t(text, label, source)",
        "length_filter": f"SELECT doc_id FROM documents WHERE length(trim(regexp_replace(text, '{_SPACES}', ' ', 'g'))) BETWEEN 8 AND 4000",
        "capped_pairs": """WITH t AS (SELECT row_id, label, source, sha256('13:' || sha256(row_id::VARCHAR)) AS o FROM test WHERE label = 0 OR row_id % 4 = 0),
            n AS (SELECT *, row_number() OVER (ORDER BY o) AS r FROM t WHERE label = 0), u AS (SELECT row_id, label, source, o FROM t WHERE label = 1 UNION ALL SELECT row_id, label, source, o FROM n WHERE r <= floor(greatest((SELECT count(*) FROM t WHERE label = 1), 1) * 2.5))
            SELECT row_id, label FROM u QUALIFY row_number() OVER (PARTITION BY label, source ORDER BY o) <= 15""",
        "capped_safe": f"""WITH {_RECORDS}, a AS (SELECT rec_id, coalesce(labels = ['safe'], false) AS safe, sha256('13:' || coalesce(hash, '') || '#' || rec_id) AS o FROM recs), k AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY o) AS r FROM a)
            SELECT rec_id FROM k WHERE NOT safe OR r <= least(300, floor(greatest((SELECT count(*) FROM a WHERE NOT safe), 1) * 0.05))""",
        "blended": "SELECT rec_id, sha256(rec_id::VARCHAR) AS hash, NULL::INT AS extra, sha256('13:' || sha256(rec_id::VARCHAR)) AS place FROM all_val UNION ALL SELECT rec_id, sha256(rec_id::VARCHAR), 1, sha256('13:' || sha256(rec_id::VARCHAR)) FROM all_test",
        "model_baseline": f"{baseline} SELECT model, labels, CASE WHEN b < 0.5 THEN 'WARN' ELSE 'PASS' END AS status, round(f * 1e9)::BIGINT AS macro_f1, round(b * 1e9)::BIGINT AS macro_best_f1, round(a * 1e9)::BIGINT AS macro_pr_auc FROM base",
        "model_status": "SELECT 'WARN' AS status",
        "label_metrics": f"""{_SCORES}, {_swept('label', 18, '0.05')}, {_ranking('label')}, {_half('label')},
            b AS (SELECT label, arg_max(threshold, (f1, -threshold)) AS best_f1_threshold, max(f1) AS best_f1, coalesce(max(threshold) FILTER (recall >= 0.9), arg_max(threshold, (f1, -threshold))) AS high_recall_threshold FROM swept GROUP BY label)
            SELECT label, (tp + fn)::BIGINT AS support, precision, recall, f1, best_f1_threshold, best_f1, high_recall_threshold, round(pr_auc * 1e9)::BIGINT AS pr_auc, round(roc_auc * 1e9)::BIGINT AS roc_auc FROM half JOIN b USING (label) JOIN ranking USING (label) WHERE tp + fn > 0""",
        "trainer_metrics": f"""{_SCORES}, {_swept('label', 19, '0.05')}, {_ranking('label')}, {_half('label')}, b AS (SELECT label, round(max(f1), 6) AS best FROM swept GROUP BY label), s AS (SELECT sum(tp) tp, sum(fp) fp, sum(fn) fn FROM half)
            SELECT 'best_f1_' || label AS name, best AS value FROM b UNION ALL SELECT 'macro_best_f1', round(avg(best), 6) FROM b UNION ALL SELECT 'macro_pr_auc', round(avg(pr_auc), 6) FROM ranking
            UNION ALL SELECT 'macro_f1', round(avg(f1), 6) FROM half UNION ALL SELECT 'micro_f1', round(2 * tp / (2 * tp + fp + fn), 6) FROM s""",
        "head_calibration": f"""{heads}, {_swept('head, label', 18, '0.05')}, c AS (SELECT head, label, arg_max(threshold, (f1, -threshold)) AS best_f1_threshold, max(f1) AS best_f1, coalesce(min(threshold) FILTER (recall >= 0.9), arg_max(threshold, (f1, -threshold))) AS high_recall_threshold,
            coalesce(max(threshold) FILTER (precision >= 0.9), arg_max(threshold, (f1, -threshold))) AS high_precision_threshold FROM swept GROUP BY head, label) SELECT *, CASE WHEN label <> 'safe' THEN high_recall_threshold END AS recommended FROM c""",
        "router_routes": f"""{router}, scores AS (SELECT 'attack' AS route, is_attack::INT AS gold, attack AS score FROM r UNION ALL SELECT 'moderation', is_moderation::INT, moderation FROM r), {_swept('route', 49, '0.02')},
            b AS (SELECT route, CASE WHEN max(f1) > 0 THEN arg_max(threshold, (f1, -threshold)) ELSE 0.0 END AS best_f1_threshold, max(f1) AS best_f1, round(greatest(0.02, coalesce(min(threshold) FILTER (recall < 0.97), 0.02) - 0.02), 2) AS threshold FROM swept GROUP BY route)
            SELECT b.route, best_f1_threshold, best_f1, b.threshold, (tp + fn)::BIGINT AS support, precision, recall, f1 FROM b JOIN swept s ON s.route = b.route AND round(s.threshold, 2) = b.threshold""",
        "router_recommendation": f"""{router}, g AS (SELECT round(i * 0.01, 2)::DOUBLE AS threshold FROM range(1, 100) t(i)), m AS (SELECT threshold, greatest(attack, moderation) < threshold AS skip, is_attack AS a, is_moderation AS b FROM r CROSS JOIN g),
            c AS (SELECT threshold, count(*) n, count(*) FILTER (skip) s, count(*) FILTER (skip AND (a OR b)) fp, count(*) FILTER (skip AND a) ma, count(*) FILTER (skip AND b) mm, count(*) FILTER (a OR b) u, count(*) FILTER (a) ta, count(*) FILTER (b) tb FROM m GROUP BY threshold),
            f AS (SELECT threshold, s AS skipped, fp AS false_pass, ma AS missed_attack, mm AS missed_moderation, s / n AS skip_pct, coalesce(fp / nullif(u, 0), 0.0) AS unsafe_miss_rate, coalesce(ma / nullif(ta, 0), 0.0) AS missed_attack_rate, coalesce(mm / nullif(tb, 0), 0.0) AS missed_moderation_rate FROM c)
            SELECT * FROM f WHERE threshold = (SELECT coalesce(arg_max(threshold, (skip_pct, threshold)) FILTER (unsafe_miss_rate <= 0.05), min(threshold)) FROM f)""",
        "merged_head": f"SELECT doc_id, {_hash('doc_id', 'h')} AS harmful_content, {_hash('doc_id', 's')} AS sexual, 0.0::DOUBLE AS safe FROM documents",
        "external_benchmark": f"""{bench}, {_swept('one', 19, '0.05')}, {_ranking('one')}, b AS (SELECT arg_max(threshold, (f1, -threshold)) AS best_threshold, max(f1) AS best_f1 FROM swept), n AS (SELECT count(*) AS rows, sum(gold)::BIGINT AS positives FROM scores)
            SELECT rows, positives, best_threshold, best_f1, r.precision AS route_precision, r.recall AS route_recall, r.f1 AS route_f1, h.precision AS default_precision, h.recall AS default_recall, h.f1 AS default_f1,
            CASE WHEN pr_auc >= 0.85 THEN 'STRONG' WHEN pr_auc >= 0.7 THEN 'OK' ELSE 'WEAK' END AS verdict, round(pr_auc * 1e9)::BIGINT AS pr_auc, round(roc_auc * 1e9)::BIGINT AS roc_auc FROM n, b, ranking, swept r, swept h WHERE r.threshold = 0.05 AND h.threshold = 0.5""",
        "benchmark_misses": f"""{bench}, {_swept('one', 19, '0.05')}, b AS (SELECT arg_max(threshold, (f1, -threshold)) AS t FROM swept), k AS (SELECT id, text, CASE WHEN gold = 1 AND score < t THEN 'false_negative' WHEN gold = 0 AND score >= t THEN 'false_positive' END AS kind FROM scores, b)
            SELECT kind, id, md5(coalesce(substr(text, 1, 90), '')) AS text_hash FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind ORDER BY id) <= 5""",
        "score_comparison": f"{cmp} SELECT {six('r.pr_auc - c.pr_auc')} AS pr_auc_drop, {six('r.best - c.best')} AS best_f1_drop, {six('r.f1 - c.f1')} AS f1_at_0_5_drop, {six('top')} AS max_abs_prob_diff, {six('mean')} AS avg_abs_prob_diff FROM m r, m c, x WHERE r.side = 'r' AND c.side = 'c'",
        "normalize_cases": _values([(i, m, e, *f) for i, m, e, *f in NORMALIZED], "id, model_text, detection_text, a, b, c, d, e, f, g, h, i",
            "id::INT AS id, model_text, detection_text, a::INT AS zero_width_removed, b::INT AS tag_chars_removed, c::BOOLEAN AS excessive_zero_width, d::DOUBLE AS non_printable_ratio, e::BOOLEAN AS high_non_printable, f::BOOLEAN AS excessive_separators, g::INT AS base64_span_count, h::BOOLEAN AS suspicious_base64, i::INT AS base64_decoded_count").replace(
            "'x1234y'", "('x' || chr(1) || chr(2) || chr(3) || chr(4) || 'y')"),
        "detector_scores": _values(DETECTED, "id, kind, label, score", "id::INT AS id, kind, label, score::DOUBLE AS score"),
        "activations": _values([(1, 0.5, 0.5), (2, 0.119202922, 0.952574127), (3, 1.0, 0.5)], "id, softmax, sigmoid", "id::INT AS id, softmax::DOUBLE AS softmax, sigmoid::DOUBLE AS sigmoid"),
        "threshold_table": _values([
            ("prompt_injection", 0.20, 0.50, 0.80), ("jailbreak", 0.20, 0.50, 0.80), ("toxicity", 0.05, 0.30, 0.60), ("hate", 0.15, 0.20, 0.40), ("sexual", 0.20, 0.50, 0.75), ("violence", 0.05, 0.30, 0.60), ("self_harm", 0.10, 0.25, 0.55),
            ("harassment", 0.20, 0.40, 0.70), ("dangerous_information", 0.20, 0.50, 0.80), ("illegal_activity", 0.20, 0.50, 0.80), ("other", 0.20, 0.50, 0.80)], "label, route, review, block", "label, route::DOUBLE AS route, review::DOUBLE AS review, block::DOUBLE AS block"),
        "final_status": _values([
            ("good", "PASS", "PASS,PASS"), ("partial", "WARN", "PASS,NOT-RUN"), ("bad", "FAIL", "FAIL,WARN"), ("nothing", "PASS", ""), ("n/a", "size", "None"), ("0.0B", "size", "0"), ("1023.0B", "size", "1023"), ("2.0KB", "size", "2048"),
            ("5.0MB", "size", "5242880"), ("3072.0GB", "size", "3298534883328")], "name, status, detail"),
        "candidate_choice": _values([("int8", "some"), ("fp32", "none")], "name, kind"),
        "metric_deltas": _values([("x", -0.04, 0.1, "WARN"), ("y", -0.02, 0.0, "PASS")], "name, macro_f1_delta, recall_delta, status", "name, macro_f1_delta::DOUBLE AS macro_f1_delta, recall_delta::DOUBLE AS recall_delta, status"),
        "component_status": _values([("a", "WARN", "OK,STRONG"), ("b", "PASS", "WEAK"), ("c", "FAIL", "STRONG,WEAK")], "part, status, verdicts"),
    }
    return out
