"""DuckDB SQL of the way from stored normalized texts to decisions.

The stand-in scorers are hashes, so that every step but normalization can be said in
SQL: head scores, routing, windows, model scores, toxic fallback, merging, decision
and reason texts.
"""

from __future__ import annotations

from . import taxonomy as T

_LABELS = ["prompt_injection", "jailbreak", "toxicity", "hate", "sexual", "violence", "self_harm", "harassment", "dangerous_information", "illegal_activity"]
_MODELS = {"prompt_injection": ["prompt_injection"], "jailbreak": ["jailbreak"], "moderation": ["toxicity", "hate", "harassment", "sexual", "violence", "self_harm"], "toxic": ["toxicity", "hate"]}
# route, review and block of each label
_LIMITS = {
    "prompt_injection": (0.20, 0.50, 0.80), "jailbreak": (0.20, 0.50, 0.80), "toxicity": (0.05, 0.30, 0.60), "hate": (0.05, 0.20, 0.40), "sexual": (0.20, 0.50, 0.75), "violence": (0.05, 0.30, 0.60),
    "self_harm": (0.10, 0.25, 0.55), "harassment": (0.20, 0.40, 0.70), "dangerous_information": (0.20, 0.50, 0.80), "illegal_activity": (0.20, 0.50, 0.80),
}
_PHRASES = [
    "ignore previous instructions", "ignore all previous instructions", "reveal your system prompt", "reveal developer message", "bypass policy", "you are now dan", "do anything now", "no restrictions",
    "unrestricted", "roleplay as", "pretend you are", "forget your instructions", "hidden prompt", "system message", "developer message", "jailbreak",
]


def _score(text: str, salt: str, label: str) -> str:
    return f"(('0x' || substr(sha256('{salt}:' || {text} || ':{label}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _words() -> str:
    return "list_filter(string_split(regexp_replace(model_text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _decided(full_scan: bool, toxic: bool, fast_block: float | None = None) -> str:
    """CTEs up to ``out``: a row for each stored text with everything decided."""
    models = [m for m in _MODELS if m != "toxic" or toxic]
    h = ", ".join(f"{_score('detection_text', 'heads', x)} AS h_{x}" for x in _LABELS)
    phrase = " OR ".join(f"contains(detection_text, '{p}')" for p in _PHRASES)
    mid = " UNION ALL SELECT norm_id, 'middle_' || ((s - 128) // 128)::VARCHAR, 2 + (s - 128) // 128, array_to_string(w[s + 1 : s + 128], ' ') FROM s, unnest(range(128, greatest(len(w) - 128, 128), 128)) u(s) WHERE len(w) > 200" if full_scan else ""
    one = " UNION ALL ".join(f"SELECT norm_id, '{m}' AS model, '{x}' AS label, name, pos, {_score('t', m, x)} AS score FROM windows" for m in models for x in _MODELS[m])
    first = "CASE " + " ".join(f"WHEN h_{x} >= {_LIMITS[x][0]} THEN '{x}'" for x in _MODELS["moderation"]) + " END"
    if full_scan:
        runs = {m: "true" for m in models}
        why = ", ".join(f"'full_scan enabled -> running {'toxic fallback' if m == 'toxic' else m}'" for m in models)
    else:
        skip = f"(h_prompt_injection >= {fast_block} OR h_jailbreak >= {fast_block})" if fast_block else "false"
        runs = {
            "prompt_injection": f"NOT {skip} AND (h_prompt_injection >= 0.2 OR phrase)", "jailbreak": f"NOT {skip} AND (phrase OR h_jailbreak >= 0.2)", "moderation": f"NOT {skip} AND {first} IS NOT NULL", "toxic": "false",
        }
        why = f"""CASE WHEN {skip} THEN 'FastText attack score ' || printf('%.3f', greatest(h_prompt_injection, h_jailbreak)) || ' >= fast_block_threshold {fast_block} -> skipping transformer' END,
            CASE WHEN NOT {skip} AND h_prompt_injection >= 0.2 THEN 'FastText attack head routed to prompt injection detector' WHEN NOT {skip} AND phrase THEN 'Attack heuristic routed to prompt injection detector' END,
            CASE WHEN NOT {skip} AND phrase THEN 'Attack heuristic routed to jailbreak detector' WHEN NOT {skip} AND h_jailbreak >= 0.2 THEN 'FastText attack head routed to jailbreak detector' END,
            CASE WHEN NOT {skip} THEN 'FastText routed ' || {first} || ' to moderation model' END"""
    cols = ", ".join(f"max(b.score) FILTER (model = '{m}' AND label = '{x}') AS m_{m}_{x}, max(b.name) FILTER (model = '{m}' AND label = '{x}') AS w_{m}_{x}" for m in models for x in _MODELS[m])
    on = lambda m, x: f"CASE WHEN run_{m} THEN m_{m}_{x} ELSE 0 END"
    far = {x: f"greatest(h_{x}, {on('moderation', x)})" for x in ("toxicity", "hate")}
    fall = "false"
    if toxic and not full_scan:
        fall = f"run_moderation AND ({far['toxicity']} BETWEEN 0.3 AND 0.7 OR {far['hate']} BETWEEN 0.3 AND 0.7 OR (greatest(h_toxicity, h_hate) >= 0.6 AND greatest({far['toxicity']}, {far['hate']}) < 0.3))"
    merged = {x: f"greatest(0, h_{x}, " + ", ".join(["0", *[on(m, x) for m in models if x in _MODELS[m] and m != "toxic"], *(["CASE WHEN run_toxic OR fall THEN m_toxic_%s ELSE 0 END" % x] if toxic and x in _MODELS["toxic"] else [])]) + ")" for x in _LABELS}
    level = {x: f"CASE WHEN s_{x} >= {_LIMITS[x][2]} THEN 3 WHEN s_{x} >= {_LIMITS[x][1]} THEN 2 WHEN s_{x} >= {_LIMITS[x][0]} THEN 1 ELSE 0 END" for x in _LABELS}
    entries = ", ".join(f"{{'s': -s_{x}, 'i': {i}, 'x': '{x}', 'l': l_{x}}}" for i, x in enumerate(_LABELS))
    names = lambda least: f"list_transform(list_sort(list_filter(e, lambda v: v.l >= {least})), lambda v: v.x)"
    hot = ", ".join(f"CASE WHEN run_{m} AND w_{m}_{x} <> 'full' AND m_{m}_{x} >= {_LIMITS[x][0]} THEN w_{m}_{x} || '_window triggered {x} score' END" for m in models if m != "toxic" or full_scan for x in _MODELS[m])
    said = ", ".join(f"CASE l_{x} WHEN 3 THEN '{x} score ' || printf('%.2f', s_{x}) || ' crossed block threshold {_LIMITS[x][2]:.2f}' WHEN 2 THEN '{x} score ' || printf('%.2f', s_{x}) || ' crossed review threshold {_LIMITS[x][1]:.2f}' END" for x in _LABELS)
    agree = ", ".join(f"CASE WHEN h_{x} >= 0.3 AND s_{x} >= 0.3 THEN 'FastText and transformer agree on {x} (ft=' || printf('%.2f', h_{x}) || ', model=' || printf('%.2f', s_{x}) || ') — elevated confidence' END" for x in _LABELS)
    told = ", 'Toxic fallback invoked on medium-confidence abuse result'" if toxic and not full_scan else ""
    ran = ", ".join([*[f"CASE WHEN run_{m} THEN '{m}' END" for m in models if m != "toxic" or full_scan], *(["CASE WHEN fall THEN 'toxic' END"] if toxic and not full_scan else [])])
    left = ", ".join(f"CASE WHEN NOT ({'run_' + m if m != 'toxic' or full_scan else 'fall'}) THEN '{m}' END" for m in models)
    return f"""WITH s AS (SELECT norm_id, model_text, detection_text, {_words()} AS w FROM normalized_text WHERE detection_text IS NOT NULL AND model_text IS NOT NULL),
      windows AS (SELECT norm_id, 'full' AS name, 0 AS pos, model_text AS t FROM s WHERE len(w) <= 200 UNION ALL SELECT norm_id, 'first', 0, array_to_string(w[1:128], ' ') FROM s WHERE len(w) > 200
        UNION ALL SELECT norm_id, 'last', 1, array_to_string(w[len(w) - 127 :], ' ') FROM s WHERE len(w) > 200{mid}),
      every AS ({one}), best AS (SELECT norm_id, model, label, max(score) AS score, arg_max(name, (score, -pos)) AS name FROM every GROUP BY ALL),
      wide AS (SELECT s.norm_id, {cols} FROM s JOIN best b USING (norm_id) GROUP BY s.norm_id),
      a AS (SELECT s.norm_id, wide.* EXCLUDE (norm_id), {h}, ({phrase}) AS phrase FROM s JOIN wide USING (norm_id)),
      b AS (SELECT *, {", ".join(f"({runs[m]}) AS run_{m}" for m in models)}, list_filter([{why}], lambda x: x IS NOT NULL) AS why FROM a),
      c AS (SELECT *, ({fall}) AS fall FROM b), d AS (SELECT *, {", ".join(f"{e} AS s_{x}" for x, e in merged.items())} FROM c),
      f AS (SELECT *, {", ".join(f"{e} AS l_{x}" for x, e in level.items())} FROM d),
      g AS (SELECT *, [{entries}] AS e, greatest({", ".join(f"l_{x}" for x in _LABELS)}) AS worst, greatest({", ".join(f"s_{x}" for x in _LABELS)}) AS top, {" + ".join(f"(l_{x} = 3)::INT" for x in _LABELS)} AS blocked FROM f),
      out AS (SELECT *, CASE worst WHEN 3 THEN 'block' WHEN 2 THEN 'review' ELSE 'allow' END AS decision,
        CASE WHEN s_self_harm >= 0.85 OR s_violence >= 0.90 OR blocked >= 2 THEN 'critical' WHEN worst = 3 THEN 'high' WHEN worst = 2 THEN 'medium' WHEN top >= 0.2 THEN 'low' ELSE 'none' END AS risk_level,
        CASE WHEN len({names(2)}) > 0 THEN {names(2)} WHEN top >= 0.2 AND len({names(1)}) > 0 THEN {names(1)}[1:1] ELSE ['safe'] END AS labels,
        list_filter(['heads', {ran}], lambda x: x IS NOT NULL) AS triggered, list_filter([{left}], lambda x: x IS NOT NULL) AS skipped,
        list_filter(list_concat(why, [{hot or "NULL"}], CASE WHEN fall THEN [{told[2:] or "NULL"}] ELSE [] END, [{said}], [{agree}]), lambda x: x IS NOT NULL) AS reasons FROM g)"""


def _gate() -> str:
    # letters, marks, digits and connectors make words, as in the operator's patterns
    word = "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]"
    gap = "[\\s.\\-](?:[\\s._\\-]*[\\s.\\-])?"  # starts and ends with what is no word character
    spaced = f"(?:(?:^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])(?:{word}{gap}){{5,}}{word}(?:[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]|$))"
    low = "lower(text)"
    mark = f"regexp_replace(regexp_replace(' ' || {low} || ' ', '([^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])({word})([\\s._\\-])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), '([^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\x01\\x02])({word})([\\s._\\-])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    joined = f"substr(regexp_replace(regexp_replace({mark}, '\\x02[\\s._\\-]+\\x01', '', 'g'), '[\\x01\\x02]', '', 'g'), 2)"
    fams = []
    for name, _, _, patterns in T.RULES:
        both = "|".join(f"(?:{p.lower()})" for p in patterns).replace("'", "''")
        fams.append(f"(regexp_matches(lower(detection_text), '{both}') OR regexp_matches(plain, '{both}')) AS g_{name}")
    hit = lambda route: " OR ".join(f"g_{n}" for n, r, _, _ in T.RULES if r == route)
    flag = lambda n: f"coalesce(flags.{n}, false)"
    signals = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in [
        ("zero_width", flag("excessive_zero_width")), ("non_printable", flag("high_non_printable")), ("base64", flag("suspicious_base64")), ("separators", flag("excessive_separators")), ("spaced_chars", "is_spaced"),
        ("homoglyphs", "regexp_matches(text, '[\\x{400}-\\x{4FF}\\x{370}-\\x{3FF}]')"),
    ])
    same = " OR ".join(f"substr(t, i - {o}, 5) = repeat(c, 5)" for o in range(5))
    return f"""WITH s AS (SELECT norm_id, coalesce(original_text, '') AS text, detection_text, flags FROM normalized_text WHERE detection_text IS NOT NULL AND model_text IS NOT NULL),
      a AS (SELECT *, regexp_matches(text, '{spaced}') AS is_spaced FROM s),
      b AS (SELECT *, translate(CASE WHEN is_spaced THEN {joined} ELSE {low} END, '0134578@$!', 'oieastbasi') AS t FROM a),
      c AS (SELECT *, array_to_string(list_filter(string_split(t, ''), lambda c, i: i = 1 OR substr(t, i - 1, 1) <> c OR c IN (chr(10), chr(13)) OR NOT ({same})), '') AS plain FROM b),
      d AS (SELECT *, {", ".join(fams)}, list_filter([{signals}], lambda x: x IS NOT NULL) AS seen FROM c),
      e AS (SELECT *, ({hit("attack")}) OR len(seen) > 0 AS attack, ({hit("moderation")}) AS moderation, ({" OR ".join(f"g_{n}" for n, _, blocks, _ in T.RULES if blocks)}) AS block FROM d)
      SELECT norm_id, concat_ws(',', CASE WHEN attack THEN 'attack' END, CASE WHEN moderation THEN 'moderation' END) AS routes,
        concat_ws(',', {", ".join(f"CASE WHEN g_{n} THEN 'rule:{n}' END" for n, *_ in T.RULES)}, CASE WHEN len(seen) > 0 THEN 'obfuscation:' || array_to_string(seen, ',') END) AS reasons,
        block, NOT (attack OR moderation OR block) AS allow_fast_skip, (attack OR moderation OR block) AS matched FROM e"""


def decisions() -> dict[str, str]:
    public = ["prompt_injection", "jailbreak", "toxicity", "hate", "sexual", "violence", "self_harm", "harassment", "dangerous_information", "illegal_activity"]
    text = "array_to_string(labels, ',') AS labels, array_to_string(triggered, ',') AS triggered"
    said = "md5(array_to_string(reasons, '|')) AS reasons_hash"
    routed, full, fast = _decided(False, True), _decided(True, True), _decided(False, False, 0.9)
    return {
        "classify_stored": f"{routed} SELECT norm_id, decision, risk_level, {text}, array_to_string(skipped, ',') AS skipped, {said}, {', '.join(f'round_even(s_{x}, 4) AS {x}' for x in public)} FROM out",
        "classify_full_scan": f"{full} SELECT norm_id, decision, risk_level, {text}, {said} FROM out",
        "classify_fast_block": f"{fast} SELECT norm_id, decision, array_to_string(triggered, ',') AS triggered, {said} FROM out",
        "stored_decisions": f"{routed}, e AS (SELECT 'decision' AS kind, decision AS name FROM out UNION ALL SELECT 'risk_level', risk_level FROM out UNION ALL SELECT 'label', unnest(labels) FROM out) SELECT kind, name, count(*) AS n FROM e GROUP BY ALL",
        "stored_routing": f"""{routed} SELECT count(*) AS requests, count(*) FILTER (len(triggered) = 1) AS heads_only, count(*) FILTER (list_contains(triggered, 'prompt_injection')) AS prompt_injection,
            count(*) FILTER (list_contains(triggered, 'jailbreak')) AS jailbreak, count(*) FILTER (list_contains(triggered, 'moderation')) AS moderation FROM out""",
        "gate_stored": _gate(),
    }
