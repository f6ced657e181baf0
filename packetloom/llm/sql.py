"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

#: ASCII white space for DuckDB's trim().
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def line_dedup(docs: str = "documents") -> str:
    """Lines of ``docs`` (doc_id, text) with key, and whether they are dropped."""
    return f"""
    lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM {docs}),
    keyed AS (
        SELECT doc_id, pos, line,
               translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines),
    common AS (
        SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (
        SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.last, FALSE) AS gone
        FROM keyed k LEFT JOIN common c ON k.key = c.key)"""


LINE_DEDUP = f"""
WITH {line_dedup()}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def license_scan() -> str:
    from packetloom.llm.licenses import TEMPLATES

    templates = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    words = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""
WITH templates(k, name, body) AS (VALUES {templates}),
t_terms AS (SELECT k, unnest({words.format('body')}) AS term FROM templates),
texts AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS text FROM documents),
total AS (SELECT count(*) AS n FROM texts),
doc_terms AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({words.format('text')}) AS term FROM texts) x),
idf AS (SELECT v.term, ln((1.0 + n) / (1.0 + count(d.doc_id))) + 1 AS idf
        FROM (SELECT term FROM t_terms UNION SELECT term FROM doc_terms) v CROSS JOIN total LEFT JOIN doc_terms d ON d.term = v.term GROUP BY v.term, n),
t_raw AS (SELECT k, t.term, count(*) * any_value(idf) AS w FROM t_terms t JOIN idf ON idf.term = t.term GROUP BY k, t.term),
t_norm AS (SELECT k, sqrt(sum(w * w)) AS norm FROM t_raw GROUP BY k),
t_vec AS (SELECT r.k, r.term, r.w / t.norm AS w FROM t_raw r JOIN t_norm t ON t.k = r.k),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS pos FROM texts),
line_terms AS (SELECT doc_id, pos, term, count(*) AS tf
               FROM (SELECT doc_id, pos, unnest({words.format('line')}) AS term FROM lines) x GROUP BY ALL),
weighed AS (SELECT l.doc_id, l.pos, l.term, l.tf, l.tf * idf.idf AS w FROM line_terms l JOIN idf ON idf.term = l.term),
line_norm AS (SELECT doc_id, pos, sqrt(sum(w * w)) AS norm, sum(tf) AS n FROM weighed GROUP BY ALL),
cosines AS (SELECT w.doc_id, w.pos, v.k, any_value(l.n) AS n, round(sum(w.w * v.w) / any_value(l.norm), 6) AS score
            FROM weighed w JOIN t_vec v ON v.term = w.term JOIN line_norm l ON l.doc_id = w.doc_id AND l.pos = w.pos
            GROUP BY w.doc_id, w.pos, v.k),
best AS (SELECT * FROM cosines WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY score DESC, k) = 1),
sizes AS (SELECT doc_id, sum(n) AS size FROM line_norm GROUP BY doc_id),
own AS (SELECT b.doc_id, arg_min(b.k, (-b.score, b.k)) AS k, max(b.score) AS score, sum(b.n) AS n FROM best b GROUP BY b.doc_id),
named AS (SELECT o.doc_id, t.name AS licence, o.score, CASE WHEN o.n >= 0.5 * s.size THEN 'file' ELSE 'header' END AS how
          FROM own o JOIN templates t ON t.k = o.k JOIN sizes s ON s.doc_id = o.doc_id),
placed AS (SELECT x.doc_id, x.path, regexp_replace(x.path, '/?[^/]*$', '') AS dir, n.licence, n.score, n.how
           FROM texts x LEFT JOIN named n ON n.doc_id = x.doc_id),
files AS (SELECT dir, arg_min(licence, (-score, licence)) AS licence, max(score) AS score FROM placed WHERE how = 'file' GROUP BY dir),
near AS (SELECT d.dir, arg_max(f.licence, length(f.dir)) AS licence, arg_max(f.score, length(f.dir)) AS score
         FROM (SELECT DISTINCT dir FROM placed) d JOIN files f ON d.dir = f.dir OR f.dir = '' OR starts_with(d.dir, f.dir || '/') GROUP BY d.dir)
SELECT p.doc_id, p.path, coalesce(p.licence, near.licence) AS licence, coalesce(p.score, near.score) AS score,
       coalesce(p.how, CASE WHEN near.licence IS NOT NULL THEN 'inherited' END) AS how
FROM placed p LEFT JOIN near ON near.dir = p.dir"""


def _components(nodes: str, links: str) -> str:
    """(id, component): the smallest id that ``links`` (a, b), given both ways, reach from each of ``nodes`` (id)."""
    return f"""
    reach AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON l.a = r.b),
    named AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""


MINHASH = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM w),
n AS (SELECT w.id, count(s.shingle) AS n FROM w LEFT JOIN s ON s.id = w.id GROUP BY w.id),
links AS (SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.id <> y.id JOIN n p ON p.id = x.id JOIN n q ON q.id = y.id
          GROUP BY x.id, y.id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
{_components('n', 'links')}
SELECT n.id AS doc_id, n.n AS n_shingles, component AS component_id, n.id = component AS kept FROM n JOIN named ON named.id = n.id"""

VECTOR_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{_components('v', 'links')}
SELECT v.id AS vec_id, count(l.b) AS n_links, any_value(component) AS component_id, v.id = any_value(component) AS kept
FROM v JOIN named ON named.id = v.id LEFT JOIN links l ON l.a = v.id GROUP BY v.id"""

PASSAGES = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k : k + 9], ' '))) AS win FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) s WHERE len(w) >= n),
held AS (SELECT s.doc_id, s.k, s.n, x.item FROM (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM starts) s JOIN windows x ON x.n = s.n AND x.win = s.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM held) y GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM held GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _tree(name: str, leaves: str) -> str:
    """Levels of the trees of ``leaves`` (tree, k, digest, n): (tree, level, k, digest, n)."""
    return f"""
    {name} AS (
        SELECT tree, 0 AS level, k, digest, n FROM {leaves}
        UNION ALL
        SELECT tree, level + 1, k // 2, sha256(string_agg(digest, '' ORDER BY k)), any_value((n + 1) // 2) FROM {name} WHERE n > 1 GROUP BY tree, level, k // 2)"""


def _leaf(n_chars: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return f"sha256({' || '.join(map(_field, values))})"


MERKLE = f"""
WITH RECURSIVE bits AS (
    SELECT b, b AS c, 0 AS turn FROM range(256) t(b)
    UNION ALL SELECT b, xor(c >> 1, (c & 1) * 3988292384), turn + 1 FROM bits WHERE turn < 8),
crc_table AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE turn = 8),
hashed AS (
    SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, {_leaf('n_chars + 1')} AS changed,
           xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
               lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1]))) AS crc
    FROM documents CROSS JOIN crc_table),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n,
           dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM hashed),
leaves AS (SELECT tree, k, leaf AS digest, n FROM ranked),
{_tree('low', 'leaves')},
roots AS (SELECT tree, digest FROM low WHERE n = 1),
crown AS (SELECT 0 AS tree, tree AS k, digest, count(*) OVER () AS n FROM roots),
{_tree('high', 'crown')},
top AS (SELECT digest AS root FROM high WHERE n = 1),
steps AS (
    SELECT r.doc_id, 0 AS part, l.level, l.k, s.digest FROM ranked r JOIN low l ON l.tree = r.tree AND l.k = r.k >> l.level AND l.n > 1
    LEFT JOIN low s ON s.tree = l.tree AND s.level = l.level AND s.k = xor(l.k, 1)
    UNION ALL
    SELECT r.doc_id, 1, h.level, h.k, s.digest FROM ranked r JOIN high h ON h.k = r.tree >> h.level AND h.n > 1
    LEFT JOIN high s ON s.level = h.level AND s.k = xor(h.k, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, level) AS turn FROM steps),
folding AS (
    SELECT doc_id, 1 AS turn, CASE WHEN crc % 7 = 0 THEN coalesce(changed, leaf) ELSE leaf END AS held FROM ranked
    UNION ALL
    SELECT f.doc_id, f.turn + 1, sha256(CASE WHEN n.k % 2 = 1 THEN coalesce(n.digest, '') || f.held ELSE f.held || coalesce(n.digest, '') END)
    FROM folding f JOIN numbered n ON n.doc_id = f.doc_id AND n.turn = f.turn),
folded AS (SELECT doc_id, arg_max(held, turn) AS folded_root FROM folding GROUP BY doc_id),
proof AS (SELECT doc_id, sha256(coalesce(string_agg(digest, '' ORDER BY turn), '')) AS proof_sha256 FROM numbered GROUP BY doc_id)
SELECT r.doc_id, r.leaf, roots.digest AS subroot, top.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ranked r JOIN roots ON roots.tree = r.tree CROSS JOIN top JOIN folded ON folded.doc_id = r.doc_id LEFT JOIN proof ON proof.doc_id = r.doc_id"""
