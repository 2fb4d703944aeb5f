"""DuckDB SQL equal to the queries of this package, where SQL can say it."""

from __future__ import annotations

# Fixed values, written down apart from those of the operator: letters that look alike in the test tables, spaces, ligatures.
_FROM = "ıɑɡΟοόЅІЈАЕОРСХВКМНТУаеорсухѕіјһԁԛԝһѐёїӓӧհոսօµфкГПФ"
_TO = "iagOoóSIJAEOPCXBKMHTYaeopcyxsijhdqwhèëïäöhnuoμφκΓΠΦ"
_BLANKS = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
_CATEGORY = """
cats AS (
  SELECT coalesce(a.label, 'unknown') AS label
  FROM all_test t LEFT JOIN label_aliases a ON a.alias = lower(trim(t.labels[1]))
),
n AS (SELECT count(*) AS n FROM all_test),
held AS (SELECT label, count(*) AS available FROM cats GROUP BY label),
p1 AS (
  SELECT s.request_id, s.label, s.target_pct, coalesce(h.available, 0)::BIGINT AS available,
         greatest(s.min_rows, (s.target_pct * ((n.n * s.sample_pct) // 100) + 99) // 100)::BIGINT AS wanted
  FROM sample_targets s CROSS JOIN n LEFT JOIN held h ON h.label = s.label
)
"""

_MIX = """
usable AS (
  SELECT regexp_replace(lower(trim(source)), '(?s)::.*$', '') AS source FROM all_test
  WHERE source IS NOT NULL AND len(labels) > 0
),
n AS (SELECT count(*) AS n FROM all_test),
held AS (SELECT source, count(*) AS held FROM usable GROUP BY source),
p3 AS (
  SELECT m.mix_id, m.source, m.target_pct, m.max_repeats, coalesce(h.held, 0)::BIGINT AS held,
         ((m.target_pct * ((n.n * m.mix_pct) // 100) + 99) // 100)::BIGINT AS wanted
  FROM mix_targets m CROSS JOIN n LEFT JOIN held h ON h.source = m.source
)
"""


_NAME = "[\\p{L}\\p{N}_-]+\\s*[:=]"
_LEAF = "lower(upper(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')))"
#: Groups of problem 2: least id over records with equal plain forms and equal fields, until nothing changes any more.
_SAME = f"""
t AS (
  SELECT rec_id, text, {_LEAF.format("text")} AS plain, text LIKE '{{%' AND json_valid(text) AS is_json FROM all_test
  WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')
),
jsons AS (
  SELECT t.rec_id, list_sort(list({_LEAF.format("j.key")} || '=' || {_LEAF.format("coalesce(json_extract_string(j.value, '$'), 'null')")})) AS fields
  FROM t, json_each(CASE WHEN is_json THEN text ELSE '{{}}' END) j WHERE is_json GROUP BY t.rec_id HAVING count(*) > 1
),
cut AS (
  SELECT rec_id, list_filter(string_split(regexp_replace(text, '(?:^|[\\r\\n|;]+)\\s*({_NAME})', chr(1) || '\\1', 'g'), chr(1)), lambda x: {_LEAF.format("x")} <> '' OR contains(x, ':') OR contains(x, '=')) AS pieces
  FROM t WHERE NOT is_json AND regexp_matches(text, '^[\\s|;]*{_NAME}')
),
named AS (
  SELECT rec_id, list_sort(list_transform(pieces, lambda x: {_LEAF.format("regexp_extract(x, '^([^:=]*)[:=]', 1)")} || '=' || {_LEAF.format("regexp_replace(x, '^[^:=]*[:=]', '')")})) AS fields
  FROM cut WHERE len(pieces) > 1
),
f AS (SELECT * FROM jsons UNION ALL SELECT * FROM named),
g0 AS (SELECT t.rec_id, t.plain, coalesce(array_to_string(f.fields, chr(2)), t.plain) AS fields FROM t LEFT JOIN f USING (rec_id)),
g1 AS (SELECT *, min(rec_id) OVER (PARTITION BY plain) AS g FROM g0),
g2 AS (SELECT rec_id, plain, fields, min(g) OVER (PARTITION BY fields) AS g FROM g1),
g3 AS (SELECT rec_id, plain, fields, min(g) OVER (PARTITION BY plain) AS g FROM g2),
g4 AS (SELECT rec_id, plain, fields, min(g) OVER (PARTITION BY fields) AS g FROM g3),
g5 AS (SELECT rec_id, min(g) OVER (PARTITION BY plain) AS g FROM g4)
"""


def _words(table: str, ident: str, name: str, extra: str = "") -> str:
    return f"""
{name} AS (
  SELECT {ident} AS id{extra}, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w
  FROM {table} WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')
),
{name}_w AS (SELECT id, len(w) AS n, unnest(w) AS word FROM {name})
"""


def _look(c: str) -> str:
    return f"nfc_normalize({_mapped(c)})"


def _mapped(c: str) -> str:
    out = f"regexp_replace({c}, '[\\p{{Cf}}\\x00-\\x08\\x0e-\\x1f\\x7f-\\x9f\\x{{34f}}\\x{{fe00}}-\\x{{fe0f}}\\x{{e0000}}-\\x{{e0fff}}]', '', 'g')"
    for ch, plain in _LIGATURES.items():
        out = f"replace({out}, '{ch}', '{plain}')"
    wide = range(0xFF01, 0xFF5F)
    a = _FROM + "".join(map(chr, [*_BLANKS, *wide]))
    b = _TO + " " * len(_BLANKS) + "".join(chr(x - 0xFEE0) for x in wide)
    return f"translate({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"


def _chunks(table: str, split: str) -> str:
    """Chunks (rec_id, split, source, digest, length) of a table; a record without words has one row of nulls."""
    return f"""SELECT rec_id, '{split}' AS split, source, md5(c) AS digest, length(replace(c, ' ', ''))::BIGINT AS length FROM (
      SELECT rec_id, source, unnest(CASE WHEN n = 0 THEN [NULL] ELSE list_transform(range(1, len(ends) + 1), lambda k: array_to_string(w[(CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END) + 1 : ends[k]], ' ')) END) AS c FROM (
        SELECT *, list_concat(list_filter(range(2, n), lambda i: ('0x' || substr(md5(w[i - 1] || ' ' || w[i]), 1, 8))::BIGINT % 4 = 0), [n]) AS ends FROM (
          SELECT rec_id, source, coalesce(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), []) AS w, coalesce(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')), 0) AS n FROM {table})))"""


_OVERLAP = f"""
chunks AS ({_chunks("all_val", "val")} UNION ALL {_chunks("all_test", "test")}),
there AS (SELECT DISTINCT digest FROM ({_chunks("all_train", "train")}) WHERE digest IS NOT NULL),
per AS (
  SELECT rec_id, split, source, count(c.digest) AS chunks, count(there.digest) AS shared, coalesce(sum(length), 0)::BIGINT AS length, coalesce(sum(length) FILTER (there.digest IS NOT NULL), 0)::BIGINT AS shared_length
  FROM chunks c LEFT JOIN there ON there.digest = c.digest GROUP BY rec_id, split, source
)
"""


def oracle_sql() -> dict[str, str]:
    p5 = " UNION ALL ".join(
        f"""SELECT '{split}' AS split, least(a.id, b.id) AS rec_id_a, greatest(a.id, b.id) AS rec_id_b
        FROM {split}_w a JOIN train_w b ON a.word = b.word GROUP BY a.id, b.id, a.n, b.n HAVING 4 * count(*) >= 3 * (a.n + b.n - count(*))"""
        for split in ("val", "test")
    )
    return {
        "p1_found": f"WITH {_CATEGORY} SELECT request_id, label FROM p1 WHERE available < wanted",
        "p1_report": f"""WITH {_CATEGORY} SELECT request_id, label, available, wanted, least(available, wanted) AS drawn, greatest(0, wanted - available)::BIGINT AS short,
            target_pct / 100 AS share_wanted, least(available, wanted) / nullif(sum(least(available, wanted)) OVER (PARTITION BY request_id), 0) AS share_reached FROM p1""",
        "p1_counts": f"WITH {_CATEGORY} SELECT request_id, label, least(available, wanted) AS drawn, least(available, wanted) AS different, 0::BIGINT AS wrong FROM p1 WHERE least(available, wanted) > 0",
        "p2_found": f"WITH {_SAME} SELECT g AS first_id, rec_id AS copy_id FROM g5 WHERE rec_id <> g",
        "p2_records": f"WITH {_SAME} SELECT g AS first_id, count(*)::BIGINT AS copies FROM g5 GROUP BY g",
        "p3_found": f"WITH {_MIX} SELECT mix_id, source FROM p3 WHERE held * max_repeats < wanted",
        "p3_report": f"""WITH {_MIX}, r AS (SELECT *, least(wanted, held * max_repeats)::BIGINT AS reached FROM p3)
            SELECT mix_id, source, target_pct, held, wanted, reached,
                   (CASE WHEN held = 0 THEN 0 ELSE least(max_repeats, (wanted + held - 1) // held) END)::INT AS most_repeats,
                   (sum(reached) OVER (PARTITION BY mix_id))::BIGINT AS mix_size FROM r""",
        "p3_draws": f"""WITH {_MIX}, r AS (SELECT *, least(max_repeats, wanted // nullif(held, 0)) AS passes FROM p3 WHERE held > 0), q AS (SELECT *, CASE WHEN passes < max_repeats THEN wanted - passes * held ELSE 0 END AS rest FROM r)
            SELECT mix_id, source, (CASE WHEN passes > 0 THEN held ELSE rest END)::BIGINT AS rows, (CASE WHEN passes > 0 THEN held ELSE rest END)::BIGINT AS different, (passes * held + rest)::BIGINT AS draws,
                   (passes > 0 AND rest > 0)::INT AS uneven, 0::BIGINT AS wrong FROM q WHERE passes * held + rest > 0""",
        "p4_groups": f"""WITH RECURSIVE {_words("test", "row_id", "t")},
            pairs AS (SELECT a.id AS a, b.id AS b FROM t_w a JOIN t_w b ON a.word = b.word AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))),
            reach AS (SELECT id, id AS r FROM t UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r),
            g AS (SELECT id, min(r) AS group_id FROM reach GROUP BY id), l AS (SELECT a AS id, count(*) AS links FROM pairs GROUP BY a)
            SELECT t.id AS row_id, (min(t.id) OVER (PARTITION BY list_sort(t.w))) AS class_id, group_id, coalesce(links, 0)::BIGINT AS links FROM t JOIN g USING (id) LEFT JOIN l USING (id)""",
        "p5_overlap": f"WITH {_OVERLAP} SELECT rec_id, split, chunks, shared, length, shared_length, shared_length / nullif(length, 0) AS overlap FROM per",
        "p5_report": f"""WITH {_OVERLAP}, {_words('all_val', 'rec_id', 'val')}, {_words('all_test', 'rec_id', 'test')}, {_words('all_train', 'rec_id', 'train')},
            pairs AS ({" UNION ALL ".join(f"SELECT '{x}' AS split, a.id AS id, count(*) = a.n AND a.n = b.n AS same FROM {x}_w a JOIN train_w b ON a.word = b.word GROUP BY a.id, b.id, a.n, b.n HAVING 4 * count(*) >= 3 * (a.n + b.n - count(*))" for x in ("val", "test"))}),
            hit AS (SELECT split, id, max(same::INT) AS same FROM pairs GROUP BY ALL),
            j AS (SELECT per.*, regexp_replace(lower(trim(source)), '(?s)::.*$', '') AS s, hit.id IS NOT NULL AS found, hit.same FROM per LEFT JOIN hit ON hit.split = per.split AND hit.id = per.rec_id)
            SELECT split, s AS source, count(*) AS records, count(*) FILTER (found) AS overlapping, coalesce(sum(same), 0)::BIGINT AS same_words, count(*) FILTER (length > 0 AND 4 * shared_length >= 3 * length) AS mostly_shared,
                   sum(shared_length) / nullif(sum(length), 0) AS text_share FROM j GROUP BY split, s""",
        "p8_faults": "SELECT spec_id, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS missing, 0::BIGINT AS wrong, 0::BIGINT AS split FROM pack_specs",
        "p4_found": f"""WITH {_words("test", "row_id", "t")}
            SELECT a.id AS row_id_a, b.id AS row_id_b FROM t_w a JOIN t_w b ON a.word = b.word AND a.id < b.id
            GROUP BY a.id, b.id, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))""",
        "p6_found": "WITH v AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, norm_id, {f} AS raw, {_look(f)} AS look FROM normalized_text WHERE {f} IS NOT NULL" for f in ("original_text", "detection_text")) + """)
            SELECT a.field, a.norm_id AS norm_id_a, b.norm_id AS norm_id_b FROM v a JOIN v b ON a.field = b.field AND a.look = b.look AND a.norm_id < b.norm_id AND a.raw <> b.raw""",
        "p6_canonical": "WITH v AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, norm_id, {_mapped(f)} AS m FROM normalized_text WHERE {f} IS NOT NULL" for f in ("original_text", "detection_text")) + """)
            SELECT field, norm_id, (min(m) OVER w) AS canonical, (count(*) OVER w)::BIGINT AS members FROM v WINDOW w AS (PARTITION BY field, nfc_normalize(m))""",
        "p6_classes": "WITH v AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, norm_id, {_look(f)} AS look FROM normalized_text WHERE {f} IS NOT NULL" for f in ("original_text", "detection_text")) + """)
            SELECT field, norm_id, least_id, members FROM (SELECT *, (min(norm_id) OVER w) AS least_id, (count(*) OVER w)::BIGINT AS members FROM v WINDOW w AS (PARTITION BY field, look))""",
        "p5_found": f"WITH {_words('all_val', 'rec_id', 'val')}, {_words('all_test', 'rec_id', 'test')}, {_words('all_train', 'rec_id', 'train')} {p5}",
    }
