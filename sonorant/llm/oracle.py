"""DuckDB SQL of the queries that SQL can express. All of them run over whole tables by brute force."""

from __future__ import annotations

from sonorant.llm.quality import STOP_WORDS

_W = r"[^\x20\x09-\x0D]+"
_COMPONENTS = """reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"""

OP2 = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS len FROM v WHERE e IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id AND x.len > 0 AND y.len > 0 WHERE list_dot_product(x.e, y.e) / (x.len * y.len) >= 0.9),
{_COMPONENTS}, c AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN least ON least.a = vec_id"""

OP4 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in sorted(set(STOP_WORDS)))})))::BIGINT AS n_stop_words FROM d LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words = 0 THEN '' ELSE concat_ws(',',
  CASE WHEN word_chars / n_words NOT BETWEEN 1.5 AND 15 THEN 'mean_word_chars' END, CASE WHEN n_symbols / n_words > 0.2 THEN 'symbols_per_word' END,
  CASE WHEN n_stop_words / n_words < 0.01 THEN 'stop_word_share' END, CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.5 THEN 'repeated_line_share' END) END AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, n_stop_words, failed_rules FROM f"""

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id"""

#: CRC-32 of a string's ASCII digits, and of the UTF-8 bytes of letters up to U+00FF, eight shifts a byte.
_CRC = """xor(4294967295, list_reduce({bytes}, lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)), 4294967295::BIGINT))"""
_DIGITS = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"


def _levels(name: str, start: str) -> str:
    return f"""{name}(tree, level, idx, n, digest) AS ({start}
  UNION ALL SELECT tree, level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 2)"""


def _field(x: str) -> str:
    return f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"


_LEAF = "sha256({})".format(" || ".join(_field(x) for x in ("doc_id", "source", "lang", "{n}", "text")))

OP13 = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.replace("{n}", "n_chars")} AS leaf,
  CASE WHEN {_CRC.format(bytes=_DIGITS)} % 7 = 0 THEN {_LEAF.replace("{n}", "n_chars + 1")} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_levels("nodes", "SELECT tree, 0, idx, n, leaf FROM placed")},
groups AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_levels("tops", "SELECT '', 0, idx, n, subroot FROM groups")},
depth AS (SELECT tree, max(level) AS depth FROM nodes GROUP BY tree),
steps(doc_id, k, tree, level, idx) AS (SELECT doc_id, 0, tree, 0, idx FROM placed
  UNION ALL SELECT s.doc_id, s.k + 1, CASE WHEN s.level < depth THEN s.tree ELSE '' END, CASE WHEN s.level < depth THEN s.level + 1 ELSE 0 END, CASE WHEN s.level < depth THEN s.idx // 2 ELSE g.idx END
  FROM steps s JOIN depth USING (tree) JOIN groups g USING (tree)
  WHERE s.tree <> '' AND s.k >= 0),
up AS (SELECT doc_id, tree, level, idx, k FROM steps WHERE tree <> ''),
over AS (SELECT p.doc_id, '' AS tree, t.level, g.idx // (1::BIGINT << t.level) AS idx, 100 + t.level AS k FROM placed p JOIN groups g USING (tree) JOIN (SELECT DISTINCT level FROM tops) t ON true),
sides AS (SELECT u.doc_id, k, u.idx, s.digest FROM up u JOIN nodes s ON s.tree = u.tree AND s.level = u.level AND s.idx = xor(u.idx, 1)
  UNION ALL SELECT o.doc_id, k, o.idx, s.digest FROM over o JOIN tops s ON s.level = o.level AND s.idx = xor(o.idx, 1)),
path AS (SELECT doc_id, k, CASE WHEN idx % 2 = 1 THEN digest ELSE '' END AS l, CASE WHEN idx % 2 = 0 THEN digest ELSE '' END AS r FROM sides
  UNION ALL SELECT doc_id, k, '', '' FROM (SELECT doc_id, k, tree, level, idx FROM up WHERE level < (SELECT depth FROM depth WHERE depth.tree = up.tree)) WHERE (doc_id, k) NOT IN (SELECT doc_id, k FROM sides)
  UNION ALL SELECT doc_id, k, '', '' FROM over WHERE level < (SELECT max(level) FROM tops) AND (doc_id, k) NOT IN (SELECT doc_id, k FROM sides)),
ordered AS (SELECT doc_id, l, r, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k FROM path),
fold(doc_id, k, acc) AS (SELECT doc_id, 0::BIGINT, coalesce(changed, leaf) FROM d UNION ALL SELECT f.doc_id, f.k + 1, sha256(l || acc || r) FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
last AS (SELECT doc_id, arg_max(acc, k) AS folded_root FROM fold GROUP BY doc_id),
proof AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY k)) AS p FROM ordered GROUP BY doc_id)
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM placed JOIN groups USING (tree) JOIN last USING (doc_id) LEFT JOIN proof USING (doc_id)"""

_RUN_BYTES = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))"

OP12 = f"""WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id,
  unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, k, {_CRC.format(bytes=_RUN_BYTES)} AS h FROM r),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
shorter AS (SELECT DISTINCT cut.word AS a, v.word AS b FROM cut JOIN v ON v.word = cut.rest),
near AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter),
best AS (SELECT a AS word, b, n AS b_n, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN v ON v.word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b_n >= 10 * v.n THEN b END AS form, CASE WHEN b_n >= 10 * v.n THEN b_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, last) AS (SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word JOIN forms l ON l.word = w.last WHERE l.form IS NULL"""
