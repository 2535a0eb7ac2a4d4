"""DuckDB statements for the operators that SQL can express, written from their definitions (whole tables)."""

from __future__ import annotations

from . import checksum_sql, hash_tree, lexical, quality_rules

_WORD = r"[^\x20\x09-\x0D]+"

LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(x, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length('<|im_start|><|im_end|>') + 2 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, (length(hex(encode(coalesce(text, '')))) / 2)::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM d, LATERAL (SELECT unnest(range(0, n - 99)) AS p) WHERE n >= 100),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
marked AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM again),
numbered AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM marked),
spans AS (SELECT doc_id, island, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY ALL),
bounds AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT d.doc_id, any_value(n) AS n, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a) AS n_spans,
    coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') || substr(any_value(h), 2 * coalesce(max(b), 0) + 1) AS rest
  FROM d LEFT JOIN bounds USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS k FROM d, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS i)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM w) WHERE least < doc_id
),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (
  SELECT words.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL), '') AS rest
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_PHRASES = "|".join(quality_rules.BOILERPLATE)
RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
w AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS k FROM d, LATERAL (SELECT unnest(range(1, len(words) - 6)) AS i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM w) WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM twice) GROUP BY doc_id),
pieces AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(0, len(parts))) AS place FROM pieces),
full_lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '{_WORD}') AS parts, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY place) > 1 AS again
  FROM lines WHERE regexp_matches(line, '{_WORD}')
),
judged AS (
  SELECT doc_id, again, chars, (
      (again AND len(parts) >= {quality_rules.REPEAT_WORDS})
      OR (len(parts) < {quality_rules.STUB_WORDS} AND NOT regexp_matches(parts[-1], '[.!?…:;。！？]["''”’»)\]*]*$'))
      OR (len(parts) >= 3 AND regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}]'))
      OR 5 * len(list_filter(parts, lambda p: p IN ('|', '»', '›', '>', '•', '·'))) >= len(parts)
      OR 10 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > chars
      OR (len(parts) <= {quality_rules.BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{_PHRASES}'))
    ) AS fails
  FROM full_lines
),
by_doc AS (
  SELECT doc_id, sum(again::INT)::BIGINT AS n_dup_lines, coalesce(sum(chars) FILTER (fails), 0) / sum(chars)::DOUBLE AS lost_share FROM judged GROUP BY doc_id
),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_share, 0.0)::DOUBLE AS lost_share
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN by_doc USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_share <= 0.5 AS kept
FROM counted
"""



def descent(name: str, tree: hash_tree.Tree) -> str:
    """Relation ``name(k, shard)``: where each of ``keys(k)`` ends in the tree."""
    rows = ", ".join(f"('{p}', '{label}', {w!r}::DOUBLE, {'NULL' if s is None else s})" for p, of in hash_tree.children(tree).items() for label, w, s in of)
    made = [f"{name}_kids(parent, label, weight, shard) AS (VALUES {rows})", f"{name}_0 AS (SELECT k, '' AS node, NULL AS shard FROM keys)"]
    draw = f"-ln((('0x' || substr(md5(k || '|' || label), 1, {hash_tree.DIGITS}))::BIGINT + 0.5::DOUBLE) / {float(16**hash_tree.DIGITS)!r}::DOUBLE) / weight"
    made += [
        f"{name}_{i + 1} AS (SELECT k, arg_min(label, {draw}) AS node, arg_min(c.shard, {draw}) AS shard FROM {name}_{i} p JOIN {name}_kids c ON p.node = c.parent GROUP BY k)"
        for i in range(hash_tree.LEVELS)
    ]
    return ", ".join([*made, f"{name} AS (SELECT k, shard FROM {name}_{hash_tree.LEVELS})"])


SHARDS = f"""
WITH {checksum_sql.TABLE},
d AS (
  SELECT doc_id, coalesce('=' || doc_id::VARCHAR, '') AS k, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
    {checksum_sql.crc32("coalesce(text, '')")} AS text_crc32
  FROM documents, crc_table
),
keys AS (SELECT DISTINCT k FROM d), {descent("held", hash_tree.even_tree(8))}, {descent("grown", hash_tree.add_weight(hash_tree.even_tree(8), 8))}
SELECT doc_id, size, text_crc32, 'key' AS law, held.shard::INT AS shard, grown.shard::INT AS grown_shard,
  row_number() OVER (PARTITION BY held.shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM d JOIN held USING (k) JOIN grown USING (k)
"""

SEARCH = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}') AS terms FROM documents
),
totals AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}')) AS term FROM benchmark
),
tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term
),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
),
parts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * n_docs) // n_terms))) AS part
  FROM tf JOIN d USING (r) JOIN weights USING (term), totals
),
scores AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(part)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""



def _step(source: str, letter: str, cost: str, said: str | None) -> str:
    """A path of state ``source`` with one more edit; no path stays none."""
    text = f"{source}.said" if said is None else f"{source}.said || CASE WHEN {source}.said = '' THEN '' ELSE chr(10) END || {said}"
    return f"CASE WHEN {source} IS NOT NULL THEN {{'cost': {source}.cost + {cost}, 'edits': {source}.edits || '{letter}', 'said': {text}}} END"


def _dynamic_programme() -> tuple[str, str]:
    """The columns of one row's step over the four role states, after inserts, and the inserts themselves."""
    insert = (
        f"x0, x1, least(x2, {_step('x0', 'I', '2', chr(39) + 'user:' + chr(39))}, {_step('x1', 'I', '2', chr(39) + 'user:' + chr(39))}, "
        f"{_step('x3', 'I', '2', chr(39) + 'user:' + chr(39))}) AS x2, x3"
    )
    insert_second = f"x0, x1, x2, least(x3, {_step('x2', 'I', '2', chr(39) + 'assistant:' + chr(39))}) AS x3"
    keep, fix = "role || ':' || text", {"user": "'user:' || text", "assistant": "'assistant:' || text"}

    def kept(source: str, initial: str) -> str:
        return f"CASE WHEN NOT gone AND role[1:1] = '{initial}' THEN {_step(source, 'K', 'cut', keep)} END"

    def fixed(source: str, role: str) -> str:
        return f"CASE WHEN NOT gone THEN {_step(source, 'R', '2 + cut', fix[role])} END"

    drop = {q: _step(q, "D", "3", None) for q in ("x0", "x1", "x2", "x3")}
    row = ", ".join([
        f"{drop['x0']} AS x0", f"least({drop['x1']}, {kept('x0', 's')}) AS x1",
        f"least({drop['x2']}, {', '.join(kept(q, 'u') + ', ' + fixed(q, 'user') for q in ('x0', 'x1', 'x3'))}) AS x2",
        f"least({drop['x3']}, {kept('x2', 'a')}, {fixed('x2', 'assistant')}) AS x3",
    ])  # fmt: skip
    return row, f"SELECT * REPLACE ({insert_second.removeprefix('x0, x1, x2, ')}) FROM (SELECT * REPLACE ({insert.removeprefix('x0, x1, ').removesuffix(', x3')}) FROM %s)"


_ROW, _INSERTS = _dynamic_programme()
_NOTHING = "NULL::STRUCT(cost BIGINT, edits VARCHAR, said VARCHAR)"
REPAIR = rf"""
WITH RECURSIVE {checksum_sql.TABLE},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {checksum_sql.crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS damage
  FROM conversations, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE damage WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM given
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'B' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'D'
      WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'T' ELSE '' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
),
seen AS (SELECT DISTINCT conv_id FROM given),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'B') AS blank, count(*) FILTER (fault = 'D') AS duplicate,
    count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (before IS NOT NULL AND before || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id
),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'cost': 0::BIGINT, 'edits': ''::VARCHAR, 'said': ''::VARCHAR}} AS x0, {_NOTHING} AS x1, {_NOTHING} AS x2, {_NOTHING} AS x3 FROM seen
  UNION ALL
  SELECT conv_id, i, {_ROW} FROM ({_INSERTS % (
      "(SELECT w.conv_id, f.i, x0, x1, x2, x3, role, text, fault IN ('B', 'D') AS gone, (fault = 'T')::BIGINT AS cut "
      "FROM walk w JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1)"
  )})
),
ends AS (
  SELECT conv_id, least(x0, x3) AS best FROM ({_INSERTS % (
      "(SELECT w.* FROM walk w LEFT JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id WHERE w.i = coalesce(c.n, 0))"
  )})
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.cost AS cost, best.edits AS audit, sha256(best.said) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLES = {
    "op2_embedding_near_dedup": LINKS, "op4_chat_formatting": CHAT, "op6_suffix_array_dedup": BYTES, "op7_substring_dedup": PASSAGES,
    "op9_quality_rules": RULES, "op11_sharding": SHARDS, "op12_conversation_repair": REPAIR, "op13_ranked_lexical_search": SEARCH,
}  # fmt: skip
