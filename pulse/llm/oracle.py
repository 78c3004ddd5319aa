"""DuckDB SQL of the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

from pulse.llm import chat, conversation_trie, line_dedup, near_vectors, ngram_join, ranked_search

# Every node with every node that links lead to; groups are small next to the table.
_REACH = """
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
component AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_W, _P = ngram_join.WIDTH, ngram_join.PERCENT
_GRAM = " || ' ' || ".join(f"words[i + {k}]" for k in range(_W))

NGRAM_JOIN = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \\t\\n\\x0B\\x0C\\r]+') AS words
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {_W} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {_W - 2}), lambda i: {_GRAM}) END) AS gram FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id < y.doc_id
           GROUP BY 1, 2),
links AS (SELECT a, b FROM shared s JOIN sizes p ON p.doc_id = s.a JOIN sizes q ON q.doc_id = s.b
          WHERE 100 * s.n >= {_P} * (p.n + q.n - s.n)),{_REACH}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN component c ON c.node = d.doc_id"""

NEAR_VECTORS = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM vectors p JOIN vectors q ON p.vec_id < q.vec_id AND len(p.v) = len(q.v)
          WHERE list_cosine_similarity(p.v, q.v) >= {near_vectors.THRESHOLD}),{_REACH},
degrees AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.component, e.vec_id) AS component_id,
       coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degrees d ON d.a = e.vec_id LEFT JOIN component c ON c.node = e.vec_id"""


def _controls(column: str) -> str:
    """Number of control strings in a text, with any number of backslashes after their first character."""
    return " + ".join("(length({0}) - length(replace({0}, '{1}', '{2}')))".format(column, c, c[1:]) for c in chat.CONTROLS)


_FRAME = len(chat.START) + len(chat.SEP) + len(chat.END)

CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_FRAME} + length(role) + length(text) + {_controls('text')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{ranked_search.TERM}')"

RANKED_SEARCH = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
sizes AS (SELECT row, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
stats AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM sizes),
wanted AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
counts AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, stats GROUP BY term),
impacts AS (SELECT c.row, s.doc_id, c.term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * s.n * n_docs) // n_all))) AS x
            FROM counts c JOIN sizes s USING (row) JOIN weights w USING (term), stats),
scores AS (SELECT i.item_id, x.doc_id, x.row, CAST(sum(i.n * x.x) AS BIGINT) AS score FROM wanted i JOIN impacts x USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {ranked_search.TOP}"""

# CRC-32 of a number's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda c, d: list_reduce(list_prepend(xor(c, d), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

CONVERSATION_TRIE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) - 1 AS place, t, length(text) AS chars FROM said),
convs AS (SELECT conv_id, {_CRC.format('conv_id')} % {conversation_trie.SHARED} AS h FROM (SELECT DISTINCT conv_id FROM said)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, b.place, b.t, b.chars FROM convs c JOIN turns b
    ON b.conv_id = c.conv_id - c.conv_id % {conversation_trie.BASES} AND b.place < c.h
  UNION ALL SELECT c.conv_id, 1, o.place, o.t, o.chars FROM convs c JOIN turns o ON o.conv_id = c.conv_id AND o.place >= c.h),
steps AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(t, '') OVER w AS node, chars FROM rebuilt
          WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)),
paths AS (SELECT conv_id, depth, node, left(node, length(node) - 64) AS parent, chars FROM steps
          UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM convs),
nodes AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, min(chars) AS chars FROM paths GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (SELECT p.node, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved
         FROM nodes u LEFT JOIN children c USING (node) JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.node),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
         FROM (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id) JOIN paths USING (conv_id, depth) GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN ends e USING (node) LEFT JOIN nodes p ON p.node = n.parent"""

ORACLE: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op8_near_vectors": NEAR_VECTORS,
    "op9_chat": CHAT,
    "op10_ngram_join": NGRAM_JOIN,
    "op11_ranked_search": RANKED_SEARCH,
    "op13_conversation_trie": CONVERSATION_TRIE,
}
