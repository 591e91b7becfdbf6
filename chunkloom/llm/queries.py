"""The registered queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    decontaminate,
    exact_dedup,
    html_text,
    jaccard_join,
    language,
    line_dedup,
    merkle,
    mixing,
    quality,
    reversed_search,
    secret_scan,
    toxicity,
    url_filter,
)
from .common import id_back, table


def op1_line_dedup(spark, sf_dir):
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op3_secret_scan(spark, sf_dir):
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark, sf_dir):
    return language.language_report(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    rows = decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(id_back().alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_html_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_merkle_manifest(spark, sf_dir):
    return merkle.merkle_manifest(table(spark, sf_dir, "documents")).drop("path")


def op13_reversed_search(spark, sf_dir):
    return reversed_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_secret_scan": op3_secret_scan,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_language_id": op7_language_id,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_html_text": op11_html_text,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_reversed_search": op13_reversed_search,
}

WHITE = r"[\x20\x09-\x0D]+"

ASSIGN_SQL = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _secret_sql() -> str:
    parts = []
    for no, rule in enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES):
        pattern = ASSIGN_SQL if rule.kind == "assign" else rule.pattern
        parts.append(
            f"SELECT doc_id, '{rule.kind}' AS kind, {no} AS kind_no, "
            f"unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS own, "
            f"unnest(string_split_regex(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}'))]) AS gap, "
            f"generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS n, {rule.least} AS least FROM d"
        )
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY n))::BIGINT AS e FROM m),
s AS (SELECT doc_id, kind, kind_no, e - length(m) AS s, e FROM p WHERE length(own) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, {text} FILTER (kind_no < 3) AS base, {text} AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


def _url_sql() -> str:
    spec = url_filter.UrlFilter()
    fits = []
    for verdict, host, path in sorted(spec.rules, key=lambda r: -len(r[1] + r[2])):
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path, verdict))
    case = lambda n: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[n]}'" for f in fits) + " END"
    bounded = lambda t: f"regexp_matches(u, '(^|[^\\p{{L}}]){t}($|[^\\p{{L}}])')"
    strict = " OR ".join(bounded(t) for t in spec.strict)
    soft = " + ".join(f"{bounded(t)}::INT" for t, _ in spec.soft)
    weight = " + ".join(f"{w} * {bounded(t)}::INT" for t, w in spec.soft)
    lower = "translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS h,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
                  CASE WHEN contains(url, '://') THEN lower(url) ELSE '' END AS u FROM pages),
q AS (SELECT page_id, {lower} AS host, path, u FROM p)
SELECT page_id, host, path, {case(1)} AS rule,
       coalesce({case(2)}, CASE WHEN {strict} OR ({soft} >= {spec.min_soft} AND {weight} >= {spec.min_weight}) THEN 'block' ELSE 'allow' END) AS verdict
FROM q"""


ORACLES = {
    "op1_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT doc_id, l, generate_subscripts(l, 1) AS s, len(regexp_extract_all(unnest(l), '[^\\x20\\x09-\\x0D]+')) AS w FROM d),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY s) AS upto FROM p),
e AS (SELECT a.doc_id, a.s, min(b.s) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.s >= a.s
      AND b.upto - (a.upto - a.w) >= {line_dedup.MIN_WORDS} GROUP BY ALL),
b AS (SELECT doc_id, s, array_to_string(l[s : e], chr(10)) AS block FROM e JOIN d USING (doc_id)),
r AS (SELECT b.doc_id, b.s, f.doc_id AS f_doc, f.s AS f_s FROM b JOIN b f ON b.block = f.block AND (f.doc_id, f.s) < (b.doc_id, b.s)),
n AS (SELECT r.doc_id, s, max(list_position(list_transform(range(0, least(len(x.l) - s, len(y.l) - f_s) + 2),
             lambda i: coalesce(x.l[s + i] <> y.l[f_s + i], true)), true) - 1) AS n
      FROM r JOIN d x ON r.doc_id = x.doc_id JOIN d y ON r.f_doc = y.doc_id GROUP BY r.doc_id, s),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS t FROM n),
i AS (SELECT doc_id, t, t - row_number() OVER (PARTITION BY doc_id ORDER BY t) AS k FROM g),
o AS (SELECT doc_id, k, min(t) - 1 AS a, max(t) AS z FROM i GROUP BY doc_id, k),
x AS (SELECT doc_id, sum(z - a) AS n_removed, string_agg(a || ':' || z, ',' ORDER BY a) AS removed FROM o GROUP BY doc_id),
y AS (SELECT p.doc_id, string_agg(l[s], chr(10) ORDER BY s) AS kept FROM p
      WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.t = p.s) GROUP BY p.doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN y ON d.doc_id = y.doc_id""",
    "op3_secret_scan": _secret_sql(),
    "op4_jaccard_join": """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.a GROUP BY d.doc_id, n.n""",
    "op5_url_filter": _url_sql(),
    "op8_decontaminate": """
WITH l AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM l),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s, w FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, w[s : s + n - 1] AS win FROM i),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, (SELECT DISTINCT n FROM wins)),
m AS (SELECT doc_id, item_id, s, p.n FROM p JOIN wins ON p.n = wins.n AND p.w[s : s + p.n - 1] = win),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id""",
    "op10_exact_dedup": f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{WHITE}', '', 'g')) AS h
           FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w""",
    # For pages whose text is in one article of h1, p, b and br, as these tables have them.
    "op11_html_text": """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, generate_subscripts(x, 1) AS i, unnest(x) AS t
      FROM (SELECT page_id, string_split_regex(regexp_replace(replace(t, '<br>', ' '), '</?b>', '', 'g'), '</?(p|h1)>') AS x FROM a)),
c AS (SELECT page_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'),
             '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS t FROM b),
e AS (SELECT page_id, i, trim(regexp_replace(t, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS t FROM c),
g AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS t FROM e WHERE t <> '' GROUP BY page_id)
SELECT a.page_id, url, coalesce(g.t, '') AS text, length(coalesce(g.t, ''))::BIGINT AS n_chars FROM a LEFT JOIN g ON a.page_id = g.page_id""",
    "op12_merkle_manifest": """
WITH RECURSIVE f AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE 'l' || lang END AS k, n_chars, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))),
             4294967295) % 7 = 0 AS hit FROM documents),
d AS (SELECT doc_id, k, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
             sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || tail) AS shown FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
t AS (SELECT k, 0 AS lvl, i, n, leaf AS h FROM o
      UNION ALL SELECT k, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY k, lvl, i // 2, n),
s AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, n, h FROM s
      UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
p AS (SELECT o.doc_id, o.k, x.lvl AS step, (o.i >> x.lvl) % 2 = 0 AS first, coalesce(y.h, '') AS sib
      FROM o JOIN (SELECT DISTINCT k, lvl FROM t WHERE n > 1) x ON o.k = x.k
      LEFT JOIN t y ON y.k = o.k AND y.lvl = x.lvl AND y.i = xor(o.i >> x.lvl, 1)
      UNION ALL
      SELECT o.doc_id, o.k, 100 + x.lvl, (s.i >> x.lvl) % 2 = 0, coalesce(y.h, '')
      FROM o JOIN s ON o.k = s.k JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) x ON true
      LEFT JOIN u y ON y.lvl = x.lvl AND y.i = xor(s.i >> x.lvl, 1)),
q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS no, first, sib FROM p),
r AS (SELECT doc_id, 0 AS no, shown AS h FROM o
      UNION ALL SELECT r.doc_id, r.no + 1, sha256(CASE WHEN first THEN h || sib ELSE sib || h END)
      FROM r JOIN q ON r.doc_id = q.doc_id AND q.no = r.no + 1),
e AS (SELECT doc_id, arg_max(h, no) AS folded_root FROM r GROUP BY doc_id),
g AS (SELECT doc_id, string_agg(sib, '' ORDER BY no) AS sibs FROM q GROUP BY doc_id)
SELECT o.doc_id, leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(sibs, '')) AS proof_sha256, folded_root,
       folded_root = (SELECT h FROM u WHERE n = 1) AS verified
FROM o JOIN s ON o.k = s.k JOIN e ON o.doc_id = e.doc_id LEFT JOIN g ON o.doc_id = g.doc_id""",
    "op13_reversed_search": """
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
c AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
k AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM l),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT t, count(*) AS df FROM c WHERE t IN (SELECT t FROM b) GROUP BY t), k),
m AS (SELECT doc_id, 100 - 90 + ((90 * n * docs) // words) AS m FROM l, k),
s AS (SELECT item_id, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM c JOIN w ON c.t = w.t JOIN b ON b.t = c.t JOIN m ON m.doc_id = c.doc_id GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
