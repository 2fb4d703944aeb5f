"""DuckDB SQL equal to the engine's queries, where SQL can say it."""

from __future__ import annotations

import re

from . import taxonomy as T
from .oracle_cases import cases
from .oracle_decisions import decisions

_R = """recs AS (
  SELECT 'train' AS split, rec_id, text, labels, source, sources, hash, raw_labels FROM all_train
  UNION ALL SELECT 'val', rec_id, text, labels, source, sources, hash, raw_labels FROM all_val
  UNION ALL SELECT 'test', rec_id, text, labels, source, sources, hash, raw_labels FROM all_test)"""
_SPACES = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, {_q(_SPACES)}, ' ', 'g'))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {_q('^' + _SPACES + '|' + _SPACES + '$')}, '', 'g')"


def _hash(key: str, label: str) -> str:
    return f"(('0x' || substr(sha256(({key})::VARCHAR || ':{label}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _has(label: str) -> str:
    return f"coalesce(list_contains(labels, {_q(label)}), false)"


def _any(labels: list[str]) -> str:
    return f"coalesce(list_has_any(labels, {_list(labels)}), false)"


_SCORES = "scores AS (" + " UNION ALL ".join(f"SELECT rec_id AS id, text, source, {_q(x)} AS label, {_has(x)}::INT AS gold, {_hash('rec_id', x)} AS score FROM recs" for x in T.SCORED) + ")"
_ALIAS = "alias(name, label) AS (VALUES " + ", ".join(f"({_q(a)}, {_q(x)})" for a, x in T.ALIAS_OF.items()) + ")"


def _rates(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    p, r = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0.0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0.0)"
    return p, r, f"coalesce(2 * ({p}) * ({r}) / nullif(({p}) + ({r}), 0), 0.0)"


def _sweep(n: int, step: str) -> str:
    p, r, f = _rates("tp", "fp", "fn")
    return f"""grid AS (SELECT round(i * {step}, 2)::DOUBLE AS threshold FROM range(1, {n + 1}) g(i)),
    counts AS (SELECT label, threshold, count(*) FILTER (gold = 1 AND score >= threshold)::DOUBLE tp, count(*) FILTER (gold = 0 AND score >= threshold)::DOUBLE fp,
      count(*) FILTER (gold = 1 AND score < threshold)::DOUBLE fn, count(*) FILTER (gold = 0 AND score < threshold)::DOUBLE tn FROM scores CROSS JOIN grid GROUP BY ALL),
    swept AS (SELECT *, {p} AS precision, {r} AS recall, {f} AS f1 FROM counts)"""


def _quality(text: str) -> str:
    return f"""CASE WHEN coalesce({text}, '') = '' THEN 'empty_text' WHEN length({text}) < 10 THEN 'too_short' WHEN length({text}) > 2000 THEN 'too_long'
      WHEN labels IS NULL OR len(labels) = 0 THEN 'no_labels' WHEN labels = ['unknown'] THEN 'only_unknown' WHEN {_has('safe')} AND {_any(T.RISK)} THEN 'mixed_safe_risk' ELSE 'kept' END"""


def _clean(merged: bool) -> str:
    src = "CASE WHEN regexp_matches(lower(source), 'forum|chat|mix') THEN 'text_moderation_' || source WHEN regexp_matches(lower(source), 'prompts|posts') THEN 'aegis_' || source ELSE source END"
    mine = (
        f"list_sort(list_filter([CASE WHEN list_has_any(l, {_list(T.HARMFUL)}) THEN 'harmful_content' END, CASE WHEN list_contains(l, 'sexual') THEN 'sexual' END], lambda x: x IS NOT NULL))"
        if merged else f"list_sort(list_distinct(list_filter(l, lambda x: list_contains({_list(T.MODERATED)}, x))))"
    )
    hints = "|".join([*T.TRUSTED_POSITIVE, *(["aegis"] if merged else [])])
    return f"""WITH {_R}, a AS (SELECT split, coalesce({_collapse('text')}, '') t, list_filter(coalesce(labels, []), lambda x: x IS NOT NULL) l, lower({src}) s FROM recs),
    b AS (SELECT *, {mine} AS mine, list_contains(l, 'safe') AND NOT list_has_any(l, {_list([*T.RISK, 'unknown'])}) AS only_safe FROM a),
    c AS (SELECT *, CASE WHEN t = '' THEN 'empty_text' WHEN length(t) < 8 THEN 'too_short' WHEN length(t) > 2000 THEN 'too_long'
      WHEN len(mine) > 0 AND NOT coalesce(regexp_matches(s, '{hints}'), false) THEN 'untrusted_positive_source'
      WHEN len(mine) = 0 AND only_safe AND NOT coalesce(regexp_matches(s, '{"|".join(T.TRUSTED_SAFE)}'), false) THEN 'untrusted_safe_source'
      WHEN len(mine) = 0 AND NOT only_safe AND list_has_any(l, ['prompt_injection', 'jailbreak', 'dangerous_information', 'illegal_activity', 'unknown']) THEN 'unsupported_risk_only'
      WHEN len(mine) = 0 AND NOT only_safe THEN 'no_supported_label' ELSE 'kept' END AS reason FROM b)
    SELECT split, reason, CASE WHEN reason <> 'kept' THEN '-' WHEN len(mine) > 0 THEN array_to_string(mine, ',') ELSE '{'' if merged else 'safe'}' END AS clean_labels, count(*) AS n FROM c GROUP BY ALL"""


_FIRST = "first_rows AS (SELECT hash, min(rec_id) AS rec_id, arg_min(labels, rec_id) AS labels FROM recs WHERE hash IS NOT NULL GROUP BY hash)"


def _stratified(names: list[str], most: int, parts: int, fill: str) -> str:
    each = max(1, most // parts)
    return f"""WITH {_R}, {_FIRST},
    l AS (SELECT DISTINCT hash, x AS label FROM first_rows, unnest(labels) u(x) WHERE list_contains({_list(names)}, x)),
    picked AS (SELECT DISTINCT hash FROM (SELECT hash, row_number() OVER (PARTITION BY label ORDER BY hash) r FROM l) WHERE r <= {each}),
    rest AS (SELECT hash, row_number() OVER (ORDER BY {fill}, hash) r FROM first_rows WHERE hash NOT IN (SELECT hash FROM picked))
    SELECT hash FROM picked UNION ALL SELECT hash FROM rest WHERE r <= greatest(0, {most} - (SELECT count(*) FROM picked))"""


def _head_rows() -> str:
    parts = []
    for head, names in T.HEADS.items():
        risk = [x for x in names if x != "safe"]
        mine = f"list_filter(l, lambda x: list_contains({_list(risk)}, x))"
        if "violence" in risk:
            mine = f"CASE WHEN len(sources) > 0 AND len(list_filter(sources, lambda s: coalesce(s = 'beavertails', false))) = len(sources) THEN list_filter({mine}, lambda x: x <> 'violence') ELSE {mine} END"
        parts.append(f"SELECT {_q(head)} AS head, split, rec_id, text, {mine} AS m, list_contains(l, 'safe') AND NOT list_has_any(l, {_list(T.RISK)}) AS safe FROM d")
    # list_distinct keeps no order, so first places are kept by hand
    d = "d AS (SELECT *, list_filter(labels, lambda x, i: x IS NOT NULL AND list_position(labels, x) = i) AS l FROM recs WHERE labels IS NOT NULL)"
    return f"WITH {_R}, {d}, p AS ({' UNION ALL '.join(parts)}), heads AS (SELECT head, split, rec_id, text, CASE WHEN len(m) > 0 THEN m WHEN safe THEN ['safe'] ELSE [] END AS labels FROM p WHERE len(m) > 0 OR safe)"


def _decide() -> str:
    m = {x: f"greatest(pow({_hash('rec_id', x)}, 4), pow({_hash(chr(39) + 'b' + chr(39) + ' || rec_id', x)} * 0.9, 4))" for x in T.SCORED}
    cols = ", ".join(f"{e} AS s_{x}" for x, e in m.items())
    lv = {x: f"CASE WHEN s_{x} >= {T.THRESHOLDS[x][2]} THEN 3 WHEN s_{x} >= {T.THRESHOLDS[x][1]} THEN 2 WHEN s_{x} >= {T.THRESHOLDS[x][0]} THEN 1 ELSE 0 END" for x in T.SCORED}
    entries = ", ".join(f"{{'s': -s_{x}, 'i': {i}, 'x': '{x}', 'l': l_{x}}}" for i, x in enumerate(T.SCORED))
    names = lambda least: f"list_transform(list_sort(list_filter(e, lambda v: v.l >= {least})), lambda v: v.x)"
    return f"""WITH {_R}, a AS (SELECT rec_id AS id, {cols} FROM recs), b AS (SELECT *, {', '.join(f'{e} AS l_{x}' for x, e in lv.items())} FROM a),
    c AS (SELECT *, [{entries}] AS e, greatest({', '.join(f'l_{x}' for x in T.SCORED)}) AS worst, greatest({', '.join(f's_{x}' for x in T.SCORED)}) AS top, {' + '.join(f'(l_{x} = 3)::INT' for x in T.SCORED)} AS blocked FROM b)
    SELECT id, CASE worst WHEN 3 THEN 'block' WHEN 2 THEN 'review' ELSE 'allow' END AS decision,
      CASE WHEN s_self_harm >= 0.85 OR s_violence >= 0.90 OR blocked >= 2 THEN 'critical' WHEN worst = 3 THEN 'high' WHEN worst = 2 THEN 'medium' WHEN top >= 0.2 THEN 'low' ELSE 'none' END AS risk_level,
      CASE WHEN len({names(2)}) > 0 THEN array_to_string({names(2)}, ',') WHEN top >= 0.2 AND len({names(1)}) > 0 THEN ({names(1)})[1] ELSE 'safe' END AS labels FROM c"""


def _windows(full_scan: bool) -> str:
    mid = " UNION ALL SELECT doc_id, 'middle_' || ((s - 128) // 128)::VARCHAR, array_to_string(w[s + 1 : s + 128], ' ') FROM t, unnest(range(128, greatest(len(w) - 128, 128), 128)) u(s) WHERE len(w) > 200" if full_scan else ""
    return f"""t AS (SELECT doc_id, c, list_filter(string_split(c, ' '), lambda x: x <> '') AS w FROM (SELECT doc_id, {_collapse('text')} AS c FROM documents WHERE text IS NOT NULL)),
    windows AS (SELECT doc_id, 'full' AS name, c AS text FROM t WHERE len(w) <= 200 UNION ALL SELECT doc_id, 'first', array_to_string(w[1:128], ' ') FROM t WHERE len(w) > 200
    UNION ALL SELECT doc_id, 'last', array_to_string(w[len(w) - 127 :], ' ') FROM t WHERE len(w) > 200{mid})"""


def _families() -> str:
    cols = []
    for name, _, _, patterns in T.RULES:
        both = "|".join(f"(?:{p.lower()})" for p in patterns)
        both = both.replace(r"\b", r"(?:\b)")
        cols.append(f"coalesce(regexp_matches(lower(text), {_q(both)}), false) AS {name}")
    return f"SELECT * FROM (SELECT doc_id, {', '.join(cols)} FROM documents) WHERE {' OR '.join(n for n, *_ in T.RULES)}"


def _weak() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(lower(text), {_q('|'.join(p))}) THEN {_q(n)} END" for n, p in T.WEAK_LABELS.items())
    return f"SELECT CASE WHEN len(l) = 0 THEN 'unknown' ELSE array_to_string(l, ',') END AS labels, count(*) AS n FROM (SELECT list_filter([{cases}], lambda x: x IS NOT NULL) AS l FROM documents WHERE {_strip('text')} <> '') GROUP BY ALL"


def _oversample(names: list[str], target: int) -> str:
    """Copies of each label's rows, label after label; ``c_x`` counts the copies that a row gets for label x."""
    rows = f"""{_R}, s0 AS (SELECT h, labels, {", ".join(f"{_has(x)} AS has_{x}, row_number() OVER (PARTITION BY {_has(x)} ORDER BY sha256('13:' || h), h) AS r_{x}" for x in names)}
        FROM (SELECT coalesce(hash, '') || '#' || rec_id AS h, labels FROM recs WHERE split = 'train'))"""
    done: list[str] = []
    for i, x in enumerate(names):
        sofar = " + ".join(["1", *[f"c_{y}" for y in done]])
        rows += f""", k{i} AS (SELECT count(*) FILTER (has_{x}) AS nat, greatest(0, {target} - coalesce(sum(CASE WHEN has_{x} THEN {sofar} END), 0)) AS need FROM s{i}),
            s{i + 1} AS (SELECT s{i}.*, (CASE WHEN has_{x} AND nat > 0 THEN need // nat + (r_{x} <= need % nat)::INT ELSE 0 END)::BIGINT AS c_{x} FROM s{i}, k{i})"""
        done.append(x)
    last, every = f"s{len(names)}", " + ".join(f"c_{x}" for x in names)
    return f"""WITH {rows} SELECT false AS copied, count(*) AS n, {", ".join(f"count(*) FILTER (has_{x}) AS {x}" for x in names)} FROM {last}
        UNION ALL SELECT true, sum({every})::BIGINT, {", ".join(f"coalesce(sum({every}) FILTER (has_{x}), 0)::BIGINT" for x in names)} FROM {last} HAVING sum({every}) > 0"""


def _route_balance(where: str, cap: int, train: bool) -> str:
    most = cap if train else max(cap // 8, 1)
    attack = _any(["prompt_injection", "jailbreak"])
    moderation = _any(["toxicity", "hate", "harassment", "sexual", "violence", "self_harm", "dangerous_information", "illegal_activity"])
    base = f"""{_R}, a AS (SELECT coalesce(hash, '') || '#' || rec_id AS h, {attack} AS a, {moderation} AS m, {_has("safe")} AS f FROM recs WHERE {where} AND labels IS NOT NULL),
        b AS (SELECT *, CASE WHEN a OR m THEN concat_ws(',', CASE WHEN a THEN 'attack' END, CASE WHEN m THEN 'moderation' END) WHEN f THEN 'safe' ELSE '' END AS routes, sha256('13:' || h) AS o FROM a),
        k AS (SELECT *, row_number() OVER (PARTITION BY a, m, routes = 'safe' ORDER BY o, h) AS r, row_number() OVER (PARTITION BY a ORDER BY o, h) AS ra FROM b),
        rest AS (SELECT routes, count(*) AS n FROM k WHERE NOT a AND (m OR routes = 'safe') AND r <= {most} GROUP BY routes),
        t AS (SELECT count(*) FILTER (a) AS n, least({most}, greatest(count(*) FILTER (a), (SELECT coalesce(sum(n), 0) FROM rest) // 3)) AS target FROM k)"""
    times = "t.target // t.n + (ra <= t.target % t.n)::INT" if train else "1"
    return f"WITH {base} SELECT routes, sum(c)::BIGINT AS n FROM (SELECT routes, {times} AS c FROM k, t WHERE a AND t.n > 0 UNION ALL SELECT routes, n FROM rest) GROUP BY routes HAVING sum(c) > 0"


def _augment() -> str:
    """Masked, zero-width and spaced variants, the first two that are new."""
    words = f"list_filter(string_split(regexp_replace(text, '{_SPACES[:-1]}+', ' ', 'g'), ' '), lambda x: x <> '')"
    zero = "text"
    for a, b in (("ignore", "ign\u200bore"), ("previous", "prev\u200bious"), ("instructions", "instr\u200buctions"), ("system", "sys\u200btem"), ("prompt", "pro\u200bmpt"), ("jailbreak", "jail\u200bbreak")):
        zero = f"replace(replace({zero}, '{a}', '{b}'), '{a.title()}', '{b}')"
    spaced = "text"
    for a in ("ignore", "bypass", "jailbreak"):
        spaced = f"replace(replace({spaced}, '{a}', '{' '.join(a)}'), '{a.title()}', '{' '.join(a)}')"
    return f"""WITH t AS (SELECT row_id, replace(replace(text, 'order', 'prompt'), 'hidden', 'bypass') AS text FROM test WHERE label = 1 AND text IS NOT NULL), w AS (SELECT *, {words} AS w FROM t),
      v AS (SELECT row_id, text, [CASE WHEN len(w) >= 6 THEN array_to_string(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 9 = 2 AND length(x) > 3 AND regexp_full_match(x, '[\\p{{L}}]+') THEN '[MASK]' ELSE x END), ' ') ELSE text END, {zero}, {spaced}] AS v FROM w),
      f AS (SELECT row_id, list_filter(v, lambda x, i: x <> text AND x <> '' AND list_position(v, x) = i)[1:2] AS v FROM v)
      SELECT row_id, (i - 1)::INT AS i, v[i] AS variant FROM f, unnest(range(1, len(v) + 1)) u(i)"""


def _more() -> dict[str, str]:
    """Evaluation, balance and adapter queries."""
    R, S = f"WITH {_R} ", f"WITH {_R}, {_SCORES}"
    p, r, f = _rates("tp", "fp", "fn")
    half = f"""{S}, half AS (SELECT label, count(*) FILTER (gold = 1 AND score >= 0.5)::DOUBLE tp, count(*) FILTER (gold = 0 AND score >= 0.5)::DOUBLE fp, count(*) FILTER (gold = 1 AND score < 0.5)::DOUBLE fn FROM scores GROUP BY label)"""
    abuse = ", ".join(f"{{'s': {_hash('rec_id', x)}, 'x': '{x}'}}" for x in ["safe", "toxicity", "hate", "harassment"])
    heads = f"""{R}, a AS (SELECT rec_id, list_distinct(list_filter(labels, lambda x: x IS NOT NULL)) AS gold, [{abuse}] AS s FROM recs WHERE len(labels) > 0),
        b AS (SELECT *, (list_sort(list_transform(s, lambda e: {{'n': -e.s, 'x': e.x}}))[1]).x AS top1, list_transform(list_filter(s, lambda e: e.s >= 0.7), lambda e: e.x) AS hits FROM a),
        h AS (SELECT rec_id, gold, top1, CASE WHEN len(hits) > 0 THEN hits ELSE [top1] END AS predicted FROM b)"""
    clean = "list_filter(labels, lambda x: x IS NOT NULL)"
    line = f"regexp_replace({_collapse('text')}, '\\n', ' ', 'g')"
    return {
        "any_label_cap": f"""{R}, e AS (SELECT DISTINCT rec_id, x FROM recs, unnest(labels) u(x) WHERE x IN ('prompt_injection', 'jailbreak', 'toxicity', 'hate', 'harassment', 'sexual', 'violence', 'self_harm', 'dangerous_information', 'illegal_activity')),
            w AS (SELECT rec_id, CASE WHEN x = 'toxicity' THEN 'hate' ELSE x END AS g, count(*) AS c FROM e GROUP BY ALL),
            b AS (SELECT rec_id, coalesce(sum(c) OVER (PARTITION BY g ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
            SELECT DISTINCT rec_id FROM b WHERE before < 30""",
        "review_block": f"""{S}, {_sweep(19, '0.05')}, b AS (SELECT label, arg_max(threshold, (f1, -threshold)) AS best, max(f1) AS top, list_sort(list(threshold) FILTER (precision >= 0.95)) AS ok FROM swept GROUP BY label),
            c AS (SELECT label, CASE WHEN top > 0 THEN best ELSE 0.5 END AS review, CASE WHEN ok[1] = 0.8 THEN coalesce(ok[2], 0.8) ELSE coalesce(ok[1], 0.8) END AS start FROM b)
            SELECT label, 0.2::DOUBLE AS route, review, greatest(review, start) AS block FROM c""",
        "macro_metrics": f"{half} SELECT count(*) AS labels, round(avg({p}) * 1e9)::BIGINT AS p9, round(avg({r}) * 1e9)::BIGINT AS r9 FROM half WHERE tp + fn > 0",
        "micro_macro": f"""{half}, t AS (SELECT sum(tp) tp, sum(fp) fp, sum(fn) fn FROM half), m AS (SELECT {f} AS f1 FROM half)
            SELECT (SELECT {f} FROM t) AS micro_f1, (SELECT round(avg(f1) * 1e9)::BIGINT FROM m) AS macro9""",
        "head_report": f"""{heads}, e AS (SELECT rec_id, unnest(list_distinct(list_concat(gold, predicted))) AS label, gold, predicted FROM h),
            c AS (SELECT label, count(*) FILTER (list_contains(gold, label) AND list_contains(predicted, label))::DOUBLE tp, count(*) FILTER (NOT list_contains(gold, label))::DOUBLE fp, count(*) FILTER (NOT list_contains(predicted, label))::DOUBLE fn FROM e GROUP BY label)
            SELECT label, tp::BIGINT tp, fp::BIGINT fp, fn::BIGINT fn, (tp + fn)::BIGINT AS support, {f} AS f1 FROM c""",
        "head_confusion": f"{heads} SELECT array_to_string(list_sort(gold), '|') AS gold, top1, count(*) AS n FROM h GROUP BY ALL",
        "score_drift": f"""{S}, d AS (SELECT abs(score - round(score * 127) / 127) AS d, (score >= 0.5) = (round(score * 127) / 127 >= 0.5) AS same FROM scores)
            SELECT count(*) AS n, max(d) AS max_abs_diff, round(avg(d) * 1e9)::BIGINT AS mean9, round(avg(same::INT) * 1e9)::BIGINT AS agree9 FROM d""",
        "head_file_scan": f"""{_head_rows()}, l AS (SELECT labels, {line} AS t FROM heads WHERE text IS NOT NULL), u AS (SELECT t, x FROM l, unnest(labels) u(x))
            SELECT md5(t) AS text_hash, string_agg(DISTINCT x, ',' ORDER BY x) AS labels FROM u GROUP BY t""",
        "merged_head_lines": f"""{R}, a AS (SELECT rec_id, {_collapse('text')} AS t, list_filter([CASE WHEN list_has_any(l, ['toxicity', 'hate', 'harassment', 'violence', 'self_harm']) THEN '__label__harmful_content' END, CASE WHEN list_contains(l, 'sexual') THEN '__label__sexual' END], lambda x: x IS NOT NULL) AS m
            FROM (SELECT *, {clean} AS l FROM recs WHERE text IS NOT NULL AND labels IS NOT NULL))
            SELECT rec_id, md5((CASE WHEN len(m) > 0 THEN array_to_string(m, ' ') ELSE '__label__safe' END) || ' ' || t) AS line_hash FROM a""",
        "adapt_civil": f"""{R}, a AS (SELECT {_has('toxicity')} t, {_has('hate')} h, {_has('violence')} v, {_has('sexual')} s, {_has('harassment')} i FROM recs WHERE {_strip("coalesce(text, '')")} <> ''),
            b AS (SELECT 'labels' AS kind, array_to_string(list_filter([CASE WHEN t THEN 'toxicity' END, CASE WHEN h THEN 'hate' END, CASE WHEN i THEN 'harassment' END, CASE WHEN v THEN 'violence' END, CASE WHEN s THEN 'sexual' END], lambda x: x IS NOT NULL), ',') AS labels FROM a)
            SELECT kind, CASE WHEN labels = '' THEN 'safe' ELSE labels END AS labels, count(*) AS n FROM b GROUP BY ALL
            UNION ALL SELECT 'route', CASE WHEN t OR h OR i OR v OR s THEN 'moderation' ELSE 'safe' END, count(*) FROM a GROUP BY ALL""",
        "head_file_round_trip": f"{_head_rows()} SELECT x AS label, count(*) AS n, (SELECT count(*) FROM heads WHERE text IS NOT NULL) AS lines FROM heads, unnest(labels) u(x) WHERE text IS NOT NULL GROUP BY x",
        "adapt_binary": f"""{R}, a AS (SELECT rec_id, CASE WHEN raw_labels IS NOT NULL THEN lower(trim(array_to_string(list_filter(raw_labels, lambda x: x IS NOT NULL), ' '))) END AS s FROM recs)
            SELECT rec_id, CASE WHEN s IS NULL OR s IN ('', 'nan', 'null') THEN NULL WHEN s IN ('true', 'yes', 'positive') THEN 1 WHEN s IN ('false', 'no', 'negative') THEN 0 WHEN try_cast(s AS DOUBLE) IS NOT NULL THEN (try_cast(s AS DOUBLE) >= 0.5)::INT
            WHEN regexp_matches(s, 'inject|attack|jailbreak|malicious|unsafe|harmful|true|1|yes|positive') THEN 1 WHEN regexp_matches(s, 'safe|benign|legit|clean|normal|harmless|none|false|0|no|negative') THEN 0 END AS binary FROM a""",
        "category_scores": f"""{R}, cat(name, labels) AS (VALUES {", ".join(f"({_q(k)}, {_list(v)})" for k, v in T.MODERATION_CATEGORIES.items())}),
            k AS (SELECT rec_id, unnest(list_distinct(list_filter(raw_labels, lambda x: x IS NOT NULL))) AS k FROM recs WHERE raw_labels IS NOT NULL), n AS (SELECT rec_id, length(k) / 100.0::DOUBLE AS v, replace(lower(trim(k)), ' ', '_') AS n FROM k),
            u AS (SELECT rec_id, v, unnest(coalesce(a.labels, b.labels, c.labels)) AS label FROM n LEFT JOIN cat a ON a.name = n LEFT JOIN cat b ON b.name = replace(n, '_', '/') LEFT JOIN cat c ON c.name = replace(n, '/', '_') WHERE NOT regexp_matches(n, 'safe|benign|ok|none|clean|neutral'))
            SELECT rec_id, label, max(v) AS score FROM u GROUP BY ALL""",
        "augment": _augment(),
        "oversample": _oversample(["toxicity", "hate", "harassment", "sexual", "violence", "self_harm"], 120),
        "route_balance": " UNION ALL ".join(f"SELECT {_q(x)} AS split, * FROM ({_route_balance(f'split = {_q(x)}', 500, x == 'train')})" for x in ("train", "val", "test")),
    }


def oracle_sql() -> dict[str, str]:
    R = f"WITH {_R} "
    S = f"WITH {_R}, {_SCORES}"
    p, r, f = _rates("tp", "fp", "fn")
    p8 = {x: f"pow({_hash('rec_id', x)}, 8)" for x in T.SCORED}
    over = lambda xs: " OR ".join(f"{p8[x]} >= {T.THRESHOLDS[x][0]}" for x in xs)
    phrase = "(" + " OR ".join(f"contains(lower(coalesce(text, '')), {_q(x)})" for x in T.ATTACK_PHRASES) + ")"
    split = "CASE WHEN ('0x' || substr({h}, 1, 8))::BIGINT % 100 < 80 THEN 'train' WHEN ('0x' || substr({h}, 1, 8))::BIGINT % 100 < 90 THEN 'val' ELSE 'test' END"
    one = f"{S}, s AS (SELECT * FROM scores)"
    gate = f"WITH {_R}, g AS (SELECT rec_id AS id, text, {_any([*T.HARMFUL, 'sexual'])} AS unsafe, greatest({_hash('rec_id', 'harmful')}, {_hash('rec_id', 'sexual')}) AS gate FROM recs)"
    gates = f"""{gate}, grid AS (SELECT round(i * 0.01, 2)::DOUBLE AS threshold FROM range(1, 100) t(i)),
      c AS (SELECT threshold, count(*)::DOUBLE total, count(*) FILTER (NOT unsafe)::DOUBLE safe_total, count(*) FILTER (unsafe)::DOUBLE unsafe_total, count(*) FILTER (gate < threshold)::DOUBLE passed,
        count(*) FILTER (gate >= threshold)::DOUBLE routed, count(*) FILTER (unsafe AND gate < threshold)::DOUBLE fn, count(*) FILTER (NOT unsafe AND gate < threshold)::DOUBLE tn,
        count(*) FILTER (unsafe AND gate >= threshold)::DOUBLE tp, count(*) FILTER (NOT unsafe AND gate >= threshold)::DOUBLE fp FROM g CROSS JOIN grid GROUP BY ALL),
      m AS (SELECT threshold, total::BIGINT total, safe_total::BIGINT safe_total, unsafe_total::BIGINT unsafe_total, passed::BIGINT passed, routed::BIGINT routed, passed / total AS pass_pct, routed / total AS call_pct,
        fn::BIGINT AS false_pass, tn::BIGINT AS true_pass, fn / unsafe_total AS unsafe_miss_rate, fn / total AS false_pass_rate_all, tn / safe_total AS safe_pass_rate,
        {p} AS route_precision, {r} AS route_recall, {f} AS route_f1 FROM c)"""
    out = {
        "normalize_core": f"SELECT doc_id, length(c) AS n, sha256(c) AS text_hash FROM (SELECT doc_id, {_collapse('text')} AS c FROM documents)",
        "snippets": f"SELECT doc_id, md5(CASE WHEN length(c) > 260 THEN substr(c, 1, 257) || '...' ELSE c END) AS snippet_hash FROM (SELECT doc_id, {_collapse('text')} AS c FROM documents WHERE text IS NOT NULL)",
        "base64_spans": "SELECT norm_id, spans FROM (SELECT norm_id, len(list_filter(regexp_extract_all(original_text, '[A-Za-z0-9+/=]+'), lambda x: regexp_full_match(x, '[A-Za-z0-9+/]{24,}={0,2}'))) AS spans FROM normalized_text WHERE original_text IS NOT NULL) WHERE spans > 0",
        "separators": "SELECT doc_id, regexp_matches(text, '-{10}|={10}|_{10}|[*]{10}|~{10}|#{10}|[.]{10}') AS excessive FROM documents WHERE text IS NOT NULL",
        "quality_records": f"""SELECT CASE WHEN text IS NULL THEN 'non_string_text' WHEN length({_strip('text')}) < 3 THEN 'too_short' WHEN length({_strip('text')}) > 20000 THEN 'too_long'
            WHEN labels IS NULL OR len(labels) = 0 THEN 'missing_labels' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY ALL""",
        "quality_finetuning": f"{R} SELECT {_quality(_strip('text'))} AS reason, count(*) AS n FROM recs GROUP BY ALL",
        "clean_records": _clean(False),
        "clean_merged": _clean(True),
        "label_map": f"""WITH {_R}, {_ALIAS}, e AS (SELECT rec_id, i, coalesce(a.label, 'unknown') AS label FROM (SELECT rec_id, unnest(raw_labels) AS x, generate_subscripts(raw_labels, 1) AS i FROM recs) t
            LEFT JOIN alias a ON a.name = regexp_replace(lower(trim(x)), '\\s+', '_', 'g')),
            f AS (SELECT rec_id, label, min(i) AS i FROM e GROUP BY ALL), u AS (SELECT rec_id, list(label ORDER BY i) AS l FROM f GROUP BY rec_id),
            v AS (SELECT rec_id, CASE WHEN list_has_any(l, {_list([*T.RISK, 'unknown'])}) THEN list_filter(l, lambda x: x <> 'safe') ELSE l END AS l FROM u)
            SELECT r.rec_id, coalesce(array_to_string(v.l, ','), 'unknown') AS mapped FROM recs r LEFT JOIN v USING (rec_id)""",
        "coarse_and_route_labels": f"""{R}, a AS (SELECT rec_id, {_any(T.HARMFUL)} h, {_has('sexual')} s, {_any(['prompt_injection', 'jailbreak'])} a, {_any([x for x in T.RISK if x not in T.HEADS['attack']])} m, {_has('safe')} f FROM recs WHERE labels IS NOT NULL)
            SELECT rec_id, concat_ws(',', CASE WHEN h THEN 'harmful_content' END, CASE WHEN s THEN 'sexual' END) AS coarse, CASE WHEN a OR m THEN concat_ws(',', CASE WHEN a THEN 'attack' END, CASE WHEN m THEN 'moderation' END) WHEN f THEN 'safe' ELSE '' END AS routes FROM a""",
        "head_projection": f"{_head_rows()} SELECT head, split, x AS label, count(*) AS n FROM heads, unnest(labels) u(x) GROUP BY ALL",
        "shared_cap": f"""{_head_rows()}, e AS (SELECT head, split, rec_id, x AS label, CASE WHEN x = 'toxicity' THEN 'hate' ELSE x END AS budget FROM heads, unnest(labels) u(x)),
            w AS (SELECT head, split, budget, rec_id, count(*) AS c FROM e GROUP BY ALL), b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY head, split, budget ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
            SELECT head, split, rec_id, label FROM e JOIN b USING (head, split, budget, rec_id) WHERE before < 40""",
        "multi_hot": f"{R} SELECT rec_id, {' || '.join(f'{_has(x)}::INT::VARCHAR' for x in T.SCORED)} AS hot FROM recs",
        "dedup_union": f"""{R}, h AS (SELECT * FROM recs WHERE hash IS NOT NULL), k AS (SELECT hash, min(rec_id) AS rec_id, count(*) AS copies FROM h GROUP BY hash),
            l AS (SELECT hash, x, min((rec_id, i)) AS pos FROM (SELECT hash, rec_id, unnest(labels) AS x, generate_subscripts(labels, 1) AS i FROM h) WHERE x IS NOT NULL GROUP BY ALL),
            l2 AS (SELECT hash, list(x ORDER BY pos) AS l FROM l GROUP BY hash), s AS (SELECT hash, x, min((rec_id, i)) AS pos FROM (SELECT hash, rec_id, unnest(sources) AS x, generate_subscripts(sources, 1) AS i FROM h) WHERE x IS NOT NULL GROUP BY ALL),
            s2 AS (SELECT hash, list(x ORDER BY pos) AS s FROM s GROUP BY hash)
            SELECT hash, rec_id, coalesce(array_to_string(CASE WHEN list_has_any(l, {_list([*T.RISK, 'unknown'])}) THEN list_filter(l, lambda x: x <> 'safe') ELSE l END, ','), '') AS labels, coalesce(array_to_string(s, ','), '') AS sources, copies
            FROM k LEFT JOIN l2 USING (hash) LEFT JOIN s2 USING (hash)""",
        "stable_split": f"WITH h AS (SELECT DISTINCT sha256({_collapse('text')}) AS h FROM documents WHERE {_collapse('text')} <> '') SELECT {split.format(h='h')} AS split, count(*) AS n FROM h GROUP BY ALL",
        "named_split": f"{R} SELECT split, CASE WHEN coalesce(starts_with(source, 'o'), false) THEN {split.format(h='sha256(text)')} ELSE split END AS named, count(*) AS n FROM recs WHERE text IS NOT NULL GROUP BY ALL",
        "held_out": f"SELECT row_id, h FROM (SELECT row_id, sha256(text) AS h FROM test WHERE text IS NOT NULL) WHERE {split.format(h='h')} = 'test'",
        "first_wins": f"{R} SELECT min(rec_id) AS rec_id, arg_min(split, rec_id) AS split FROM recs WHERE coalesce(hash, text) IS NOT NULL GROUP BY coalesce(hash, text)",
        "priority_dedup": f"""{R}, a AS (SELECT split, rec_id, row_number() OVER (PARTITION BY hash ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, rec_id) AS r FROM recs WHERE hash IS NOT NULL)
            SELECT split, count(*) AS n, sum(rec_id)::BIGINT AS ids FROM a WHERE r = 1 GROUP BY split""",
        "leakage": f"{R} SELECT hash, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM recs WHERE hash IS NOT NULL GROUP BY hash HAVING count(DISTINCT split) > 1",
        "unseen": "SELECT rec_id FROM all_test WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM all_train WHERE hash IS NOT NULL)",
        "split_sources": f"{R} SELECT split, source, count(*) AS n, (grouping(split) * 2 + grouping(source))::BIGINT AS level FROM recs GROUP BY GROUPING SETS ((split, source), (split), (source), ())",
        "stratified_sample": _stratified(T.SCORED, 200, len(T.SCORED) + 1, "hash"),
        "stratified_eval_cap": _stratified(T.MODERATED, 150, len(T.MODERATED) + 2, "sha256('13:' || hash)"),
        "source_cap": f"{R}, a AS (SELECT source, rec_id, row_number() OVER (PARTITION BY source ORDER BY rec_id) AS r FROM recs) SELECT source, count(*) AS n, max(rec_id) AS last FROM a WHERE r <= 25 GROUP BY source",
        "safe_downsample": f"""{R}, a AS (SELECT hash || '#' || rec_id AS hash, {_any(T.RISK)} AS risk FROM recs WHERE hash IS NOT NULL)
            SELECT hash FROM a WHERE risk UNION ALL SELECT hash FROM (SELECT hash, row_number() OVER (ORDER BY sha256('13:' || hash)) AS r FROM a WHERE NOT risk) WHERE r <= 100""",
        "hard_negatives": """WITH a AS (SELECT row_id, label, sha256('13:' || sha256(row_id::VARCHAR)) AS o FROM test)
            SELECT row_id FROM a WHERE label = 1 UNION ALL SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY o) AS r FROM a WHERE NOT coalesce(label = 1, false)) WHERE r <= greatest((SELECT count(*) FROM test WHERE label = 1), 1)""",
        "balanced_sample": "SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256(row_id::VARCHAR)) AS r FROM test WHERE label IS NOT NULL) WHERE r <= CASE label WHEN 1 THEN 50 ELSE 51 END",
        "random_sample": "SELECT doc_id FROM documents ORDER BY sha256('13:' || doc_id::VARCHAR) LIMIT 50",
        "fold_eval_rows": f"""{R}, c AS (SELECT x AS label, count(DISTINCT rec_id) AS n FROM recs, unnest(labels) u(x) WHERE split = 'train' GROUP BY x), low AS (SELECT list(label) AS l FROM c WHERE n < 60 AND list_contains({_list(T.SCORED)}, label))
            SELECT rec_id, 'train' AS split, split AS folded_from_split, coalesce(source, '') || '::folded_from_' || split AS source FROM recs, low WHERE split <> 'train' AND list_has_any(labels, l)""",
        "class_weights": f"{R}, c AS (" + " UNION ALL ".join(f"SELECT {_q(x)} AS label, count(*) FILTER ({_has(x)}) AS positives, count(*) AS n FROM recs" for x in T.SCORED) + ") SELECT label, positives, n - positives AS negatives, greatest(least(sqrt(greatest(n - positives, 1) / greatest(positives, 1)), 30.0), 1.0) AS weight FROM c",
        "gate_families": _families(),
        "attack_phrases": "SELECT row_id, " + " OR ".join(f"contains(replace(lower(text), 'the text above is void', 'hidden prompt'), {_q(x)})" for x in T.ATTACK_PHRASES) + " AS phrase FROM test WHERE text IS NOT NULL",
        "weak_labels": _weak(),
        "text_windows": f"WITH {_windows(True)} SELECT doc_id, name, md5(text) AS text_hash FROM windows",
        "window_merge": f"WITH {_windows(False)}, s AS (" + " UNION ALL ".join(f"SELECT doc_id, name, CASE name WHEN 'last' THEN 1 ELSE 0 END AS pos, {_q(x)} AS label, {_hash(chr(100) + 'oc_id || ' + chr(39) + '/' + chr(39) + ' || name', x)} AS score FROM windows" for x in T.PUBLIC) + ") SELECT doc_id, label, max(score) AS score, arg_max(name, (score, -pos)) AS \"window\" FROM s GROUP BY ALL",
        "merge_and_decide": _decide(),
        "route_models": f"{R} SELECT rec_id AS id, concat_ws(',', CASE WHEN {over(['prompt_injection'])} OR {phrase} THEN 'prompt_injection' END, CASE WHEN {over(['jailbreak'])} OR {phrase} THEN 'jailbreak' END, CASE WHEN {over(T.MODERATED)} THEN 'moderation' END) AS models FROM recs",
        "suggest_models": f"{R} SELECT rec_id AS id, concat_ws(',', CASE WHEN {over(['prompt_injection'])} THEN 'prompt_injection' END, CASE WHEN {over(['jailbreak'])} THEN 'jailbreak' END, CASE WHEN {over(T.MODERATED)} THEN 'moderation' END) AS models FROM recs",
        "confusion": f"{S}, counts AS (SELECT label, count(*) FILTER (gold = 1 AND score >= 0.5)::DOUBLE tp, count(*) FILTER (gold = 0 AND score >= 0.5)::DOUBLE fp, count(*) FILTER (gold = 1 AND score < 0.5)::DOUBLE fn, count(*) FILTER (gold = 0 AND score < 0.5)::DOUBLE tn FROM scores GROUP BY label) SELECT label, tp::BIGINT tp, fp::BIGINT fp, fn::BIGINT fn, tn::BIGINT tn, {p} AS precision, {r} AS recall, {f} AS f1 FROM counts",
        "sweep": f"{S}, {_sweep(18, '0.05')} SELECT label, threshold, tp::BIGINT tp, fp::BIGINT fp, fn::BIGINT fn, tn::BIGINT tn, precision, recall, f1 FROM swept",
        "thresholds": f"{S}, {_sweep(19, '0.05')} SELECT label, arg_max(threshold, (f1, -threshold)) AS best, coalesce(max(threshold) FILTER (recall >= 0.9), arg_max(threshold, (f1, -threshold))) AS recall_high, coalesce(min(threshold) FILTER (recall >= 0.9), arg_max(threshold, (f1, -threshold))) AS recall_low, coalesce(max(threshold) FILTER (precision >= 0.9), arg_max(threshold, (f1, -threshold))) AS precise FROM swept GROUP BY label",
        "route_floor": f"{S}, {_sweep(18, '0.05')} SELECT label, precision, recall, (tp + fp)::BIGINT AS predicted FROM swept WHERE threshold = 0.05",
        "fine_thresholds": f"{S}, {_sweep(49, '0.02')}, b AS (SELECT label, arg_max(threshold, (f1, -threshold)) AS threshold FROM swept GROUP BY label) SELECT label, threshold, tp::BIGINT tp, fp::BIGINT fp, fn::BIGINT fn FROM swept JOIN b USING (label, threshold)",
        "pr_auc": f"""{S}, a AS (SELECT label, score, sum(gold) AS p, count(*) AS n FROM scores GROUP BY ALL), b AS (SELECT label, p, sum(p) OVER w AS tp, sum(n) OVER w AS al, sum(p) OVER (PARTITION BY label) AS pos FROM a WINDOW w AS (PARTITION BY label ORDER BY score DESC))
            SELECT label, round(sum(p / pos * tp / al) * 1e6)::BIGINT AS pr_auc_millionths FROM b GROUP BY label""",
        "roc_auc": f"""{S}, a AS (SELECT label, score, sum(gold) AS p, sum(1 - gold) AS q FROM scores GROUP BY ALL), b AS (SELECT label, p, q, coalesce(sum(q) OVER (PARTITION BY label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a)
            SELECT label, sum(p * (2 * below + q))::DOUBLE / (2 * sum(p) * sum(q))::DOUBLE AS roc_auc FROM b GROUP BY label""",
        "head_summary": f"""{R}, a AS (SELECT rec_id, list_filter(labels, lambda x: x IS NOT NULL) AS gold, [{', '.join(f"{{'s': -{_hash('rec_id', x)}, 'x': '{x}'}}" for x in T.HEADS['abuse'])}] AS s FROM recs WHERE len(labels) > 0)
            SELECT count(*) AS records, count(*) FILTER (list_contains(gold, (list_sort(s)[1]).x)) AS top1_right FROM a""",
        "gate_metrics": f"{gates} SELECT * FROM m",
        "gate_choice": f"{gates} SELECT coalesce(arg_max(threshold, (round(pass_pct, 4), threshold)) FILTER (round(unsafe_miss_rate, 4) <= 0.02), min(threshold)) AS threshold FROM m",
        "false_pass_samples": f"{gate} SELECT id, md5(substr(text, 1, 240)) AS text_hash FROM g WHERE text IS NOT NULL AND unsafe AND gate < 0.3 ORDER BY id LIMIT 25",
        "fast_allow": f"""{R}, g AS (SELECT greatest({_hash('rec_id', 'attack')}, {_hash('rec_id', 'moderation')}) AS top, {_any(['prompt_injection', 'jailbreak'])} a, {_any([x for x in T.RISK if x not in T.HEADS['attack']])} m FROM recs), grid AS (SELECT round(i * 0.02, 2)::DOUBLE AS threshold FROM range(1, 50) t(i)),
            c AS (SELECT threshold, count(*) n, count(*) FILTER (top < threshold) s, count(*) FILTER (top < threshold AND (a OR m)) fp, count(*) FILTER (top < threshold AND a) ma, count(*) FILTER (top < threshold AND m) mm, count(*) FILTER (a OR m) u, count(*) FILTER (a) ta, count(*) FILTER (m) tm FROM g CROSS JOIN grid GROUP BY threshold)
            SELECT threshold, s AS skipped, fp AS false_pass, ma AS missed_attack, mm AS missed_moderation, s / n AS skip_pct, fp / u AS unsafe_miss_rate, ma / ta AS missed_attack_rate, mm / tm AS missed_moderation_rate FROM c""",
        "route_thresholds": f"{S}, {_sweep(49, '0.02')} SELECT label, round(greatest(0.02, coalesce(min(threshold) FILTER (recall < 0.97), 0.02) - 0.02) * 100)::BIGINT AS percent FROM swept GROUP BY label",
        "label_distribution": f"{R}, t AS (SELECT count(*) AS n FROM recs), e AS (SELECT split, x AS label FROM recs, unnest(labels) u(x) WHERE x IS NOT NULL) SELECT label, count(*) AS n, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) / (SELECT n FROM t) AS share FROM e GROUP BY label",
        "top_sources": f"{R}, e AS (SELECT x AS label, coalesce(source, 'unknown') AS source, count(*) AS n FROM recs, unnest(labels) u(x) WHERE x IS NOT NULL GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, source)::INT AS place FROM e) SELECT label, source, n, place FROM p WHERE place <= 5",
        "record_checks": f"{R} SELECT count(*) AS records, count(*) FILTER ({_strip("coalesce(text, '')")} = '') AS empty_text, count(*) FILTER (labels IS NULL OR len(labels) = 0) AS missing_labels, coalesce(sum(len(list_filter(labels, lambda x: x = 'unknown'))), 0)::BIGINT AS unknown_entries FROM recs",
        "length_stats": f"{R}, a AS (SELECT split, length(coalesce(text, '')) AS l FROM recs), b AS (SELECT split, list_sort(list(l)) AS l, sum(l)::DOUBLE AS s FROM a GROUP BY split) SELECT split, len(l) AS n, s / len(l) AS avg, l[1] AS min, l[len(l)] AS max, l[floor(0.5::DOUBLE * (len(l) - 1))::INT + 1] AS p50, l[floor(0.95::DOUBLE * (len(l) - 1))::INT + 1] AS p95 FROM b",
        "imbalance": f"{R}, e AS (SELECT split, x, count(*)::DOUBLE AS n FROM recs, unnest(labels) u(x) WHERE x IS NOT NULL GROUP BY ALL) SELECT split, max(n) / min(n) AS imbalance FROM e GROUP BY split",
        "event_percentiles": "WITH a AS (SELECT event_type, list_sort(list(round(value * 100)::BIGINT)) AS l FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, len(l) AS n, l[1] AS min, l[len(l)] AS max, l[floor(0.5::DOUBLE * (len(l) - 1))::INT + 1] AS p50, l[floor(0.95::DOUBLE * (len(l) - 1))::INT + 1] AS p95, l[floor(0.99::DOUBLE * (len(l) - 1))::INT + 1] AS p99 FROM a",
        "error_buckets": f"{one} SELECT label, CASE WHEN score >= 0.9 THEN '0.90-1.00' WHEN score >= 0.75 THEN '0.75-0.90' WHEN score >= 0.5 THEN '0.50-0.75' WHEN score >= 0.25 THEN '0.25-0.50' WHEN score >= 0.1 THEN '0.10-0.25' ELSE '0.00-0.10' END AS bucket, count(*) AS n, count(*) FILTER (gold = 1) AS positives, count(*) FILTER (gold = 0 AND score >= 0.6) AS false_positives, count(*) FILTER (gold = 1 AND score < 0.6) AS false_negatives FROM s GROUP BY ALL",
        "error_sources": f"""{one}, k AS (SELECT label, 'positive' AS kind, source FROM s WHERE gold = 1 UNION ALL SELECT label, 'false_positive', source FROM s WHERE gold = 0 AND score >= 0.6 UNION ALL SELECT label, 'false_negative', source FROM s WHERE gold = 1 AND score < 0.6),
            c AS (SELECT label, kind, coalesce(source, 'unknown') AS source, count(*) AS n FROM k GROUP BY ALL) SELECT label, kind, source, n FROM (SELECT *, row_number() OVER (PARTITION BY label, kind ORDER BY n DESC, source) AS r FROM c) WHERE r <= 5""",
        "worst_false_positives": f"{one} SELECT label, id, score FROM s WHERE gold = 0 AND score >= 0.6 QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, id) <= 20",
        "weakest_positives": f"{one} SELECT label, id, score FROM s WHERE gold = 1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY score, id) <= 20",
        "build_summary": f"{R} SELECT split, count(*) AS rows, count(*) FILTER ({_any(T.MODERATED)}) AS positives, count(*) FILTER (coalesce(labels = ['safe'], false)) AS safe_rows, {', '.join(f'count(*) FILTER ({_has(x)}) AS {x}' for x in T.MODERATED)} FROM recs GROUP BY split",
        "head_file_checks": f"{_head_rows()}, w(head, label) AS (VALUES {', '.join(f'({_q(h)}, {_q(x)})' for h, xs in T.HEADS.items() for x in xs)}), c AS (SELECT head, labels[1] AS label, count(*) AS n FROM heads WHERE text IS NOT NULL GROUP BY ALL) SELECT head, label, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'FAIL' WHEN n < 100 THEN 'WARN' ELSE 'PASS' END AS status FROM w LEFT JOIN c USING (head, label)",
        "head_file_labels": f"{_head_rows()} SELECT x AS label, count(*) AS n FROM heads, unnest(labels) u(x) WHERE text IS NOT NULL GROUP BY x",
        "adapt_columns": f"""{R}, a AS (SELECT list_filter([CASE WHEN {_has('toxicity')} THEN 'toxic' END, CASE WHEN {_has('violence')} THEN 'threat' END, CASE WHEN {_has('harassment')} THEN 'insult' END], lambda x: x IS NOT NULL) AS l FROM recs WHERE {_strip('text')} <> '')
            SELECT CASE WHEN len(l) = 0 THEN 'safe' ELSE array_to_string(l, ',') END AS labels, count(*) AS n FROM a GROUP BY ALL""",
        "adapt_generic": f"SELECT labels, count(*) AS n FROM (SELECT coalesce(array_to_string(list_filter(list_transform(string_split(array_to_string(list_filter(labels, lambda x: x IS NOT NULL), ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), ','), 'safe') AS labels FROM documents WHERE {_strip('text')} <> '') GROUP BY ALL",
        "quota_scan": "SELECT doc_id, kind FROM (SELECT doc_id, kind, row_number() OVER (PARTITION BY coalesce(kind, '-') ORDER BY doc_id) AS r FROM documents WHERE length(trim(text)) BETWEEN 8 AND 2000) WHERE r <= 20",
        "tumbling_events": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL",
    }
    out |= _more() | cases() | decisions()
    return {k: re.sub(r"\n\s+", " ", v) for k, v in out.items()}
