"""Queries over column functions: paths, texts, references, imports."""

from __future__ import annotations


from pyspark.sql import functions as F

from changeloom.functions import imports as I
from changeloom.functions import paths as PF
from changeloom.functions import text as TF
from changeloom.functions import web as W
from changeloom.operators import aggregate as A
from changeloom.operators import terraform as TR
from changeloom.operators import triage as TG
from changeloom.plans import code_view as C
from changeloom.plans import oracle_views as O
from changeloom.plans import views as V
from changeloom.plans.registry import query
from changeloom.settings import DEFAULTS
from changeloom.sources.shared import materialize_once

KEY = ["change_id", "file_idx"]


@query("classify_layer", f"WITH {O.DOCS} SELECT change_id, file_idx, {O.layer('path')} AS layer FROM docs")
def classify_layer(spark, sf_dir):
    return V.documents(spark, sf_dir).select(*KEY, PF.classify_layer(F.col("path")).alias("layer"))


@query("classify_language", f"WITH {O.DOCS} SELECT change_id, file_idx, {O.language('path')} AS language FROM docs")
def classify_language(spark, sf_dir):
    return V.documents(spark, sf_dir).select(*KEY, PF.classify_language(F.col("path")).alias("language"))


MESSY = "'./' || CASE doc_id % 4 WHEN 0 THEN 'x/../' || path WHEN 1 THEN replace(path, '/', '//') WHEN 2 THEN '../' || path || '/.' ELSE './a/./b/../../' || path END"


@query("normalize_path", f"""WITH {O.DOCS}
SELECT change_id, file_idx, CASE doc_id % 4 WHEN 2 THEN '../' || path ELSE path END AS path FROM docs""")
def normalize_path(spark, sf_dir):
    docs = V.documents(spark, sf_dir)
    return docs.select(*KEY, PF.normalize_path(F.expr(MESSY)).alias("path"))


@query("path_parts", f"""WITH {O.DOCS}
SELECT change_id, file_idx, len(string_split(path, '/')) AS parts,
       CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS top, split_part(path, '/', -1) AS last_part FROM docs""")
def path_parts(spark, sf_dir):
    parts = PF.path_parts(F.concat(F.lit("/"), "path", F.lit("/")))
    return V.documents(spark, sf_dir).select(
        *KEY, F.size(parts).alias("parts"), PF.top_directory(F.col("path")).alias("top"),
        F.element_at(parts, -1).alias("last_part"),
    )


@query("path_suffixes", f"""WITH {O.DOCS}, p AS (SELECT change_id, file_idx, string_split(path, '/') AS s FROM docs)
SELECT change_id, file_idx, array_to_string(s[k:], '/') AS suffix FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM p)""")
def path_suffixes(spark, sf_dir):
    return V.documents(spark, sf_dir).select(*KEY, F.explode(PF.path_suffixes(F.col("path"))).alias("suffix"))


@query("platform_infix", f"""WITH {O.DOCS}
SELECT change_id, file_idx, regexp_replace(path, '\\.ios\\.ts$', '') AS module FROM docs WHERE path LIKE '%.ios.ts'""")
def platform_infix(spark, sf_dir):
    module = PF.platform_module(PF.without_extension(F.col("path")))
    return V.documents(spark, sf_dir).select(*KEY, module.alias("module")).where("module IS NOT NULL")


TRIAGED = O.FILES + O.ATTRS + """,
triaged AS (
  SELECT f.*, CASE WHEN status = 'renamed' AND similarity = 100 AND NOT mode_changed AND additions = 0 AND deletions = 0 AND hunk_count = 0 THEN 'exact rename'
              WHEN g.path IS NOT NULL THEN 'generated' WHEN "binary" THEN 'binary' END AS reason
  FROM files f LEFT JOIN generated g USING (change_id, path)),
blank AS (
  SELECT change_id, file_idx FROM lines GROUP BY ALL
  HAVING count(*) FILTER (t <> 'c') > 0 AND
         coalesce(regexp_replace(string_agg(text, '' ORDER BY pos) FILTER (t = 'd'), '[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g'), '') =
         coalesce(regexp_replace(string_agg(text, '' ORDER BY pos) FILTER (t = 'a'), '[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', '', 'g'), '')),
flagged AS (
  SELECT t.*, concat_ws('; ', CASE WHEN path LIKE 'vendor/%' THEN 'vendored path' END,
     CASE WHEN path LIKE '%.min.%' THEN 'minified-looking filename' END,
     CASE WHEN b.file_idx IS NOT NULL THEN 'whitespace-only changes' END) AS flags
  FROM triaged t LEFT JOIN blank b USING (change_id, file_idx))"""


def triaged(spark, sf_dir):
    return TG.triage(V.files(spark, sf_dir), V.attributes(spark, sf_dir))


def flagged(spark, sf_dir):
    return TG.heuristic_flags(triaged(spark, sf_dir), V.lines(spark, sf_dir))


@query("triage", "WITH " + TRIAGED + " SELECT change_id, file_idx, path, reason FROM triaged")
def triage(spark, sf_dir):
    return triaged(spark, sf_dir).select(*KEY, "path", "reason")


@query("heuristic_flags", "WITH " + TRIAGED + " SELECT change_id, file_idx, flags FROM flagged")
def heuristic_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select(*KEY, F.array_join("flags", "; ").alias("flags"))


@query("whitespace_only", "WITH " + TRIAGED.replace("FROM lines GROUP BY ALL", "FROM spaced GROUP BY ALL").replace("blank AS", """spaced AS (
  SELECT change_id, file_idx, pos, t, text FROM lines
  UNION ALL SELECT change_id, file_idx, pos, CASE t WHEN 'a' THEN 'd' ELSE 'a' END, chr(160) || replace(text, ' ', chr(9) || ' ')
  FROM lines WHERE doc_id % 3 = 0 AND t <> 'c'),
blank AS""", 1) + " SELECT change_id, file_idx FROM blank")
def whitespace_only(spark, sf_dir):
    """Every changed line of every third file also comes with the other sign and other white space."""
    rows = V.lines(spark, sf_dir)
    spaced = F.concat(F.lit("\u00a0"), F.replace(F.col("text"), F.lit(" "), F.lit("\t ")))
    turned = rows.where("doc_id % 3 = 0 AND t <> 'c'").withColumn("text", spaced).withColumn(
        "t", F.when(F.col("t") == "a", "d").otherwise("a")
    )
    return TG.whitespace_only(rows.unionByName(turned))


@query("long_line", f"WITH {O.LINES} SELECT change_id, file_idx, pos FROM lines WHERE length(text) > 300")
def long_line(spark, sf_dir):
    return V.lines(spark, sf_dir).where(TF.long_line(F.col("text"), 300)).select(*KEY, F.col("pos").cast("bigint").alias("pos"))


LINK_SQL = """
tags AS (
  SELECT page_id, unnest(regexp_extract_all(
    regexp_replace(regexp_replace(regexp_replace(html, '<!--(?s:.*?)-->', ' ', 'g'), '(<script)((?:[^>"'']|"[^"]*"|''[^'']*'')*>)(?s:.*?)</script>', '\\1\\2', 'gi'),
      '(<style)((?:[^>"'']|"[^"]*"|''[^'']*'')*>)(?s:.*?)</style>', '', 'gi'),
    '(?i)<(?:a|script|link|img)\\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM pages),
refs AS (
  SELECT page_id, CASE WHEN regexp_matches(tag, '(?i)^<(a|link)\\b') THEN regexp_extract(tag, '(?i)\\shref\\s*=\\s*["'']([^"'']*)', 1)
                       ELSE regexp_extract(tag, '(?i)\\ssrc\\s*=\\s*["'']([^"'']*)', 1) END AS ref FROM tags)"""


RELATIVE_PAGES = "pages AS (SELECT page_id, replace(html, 'href=\"/', 'href=\"') AS html FROM main.pages),"


@query("html_refs", f"""WITH {RELATIVE_PAGES}{LINK_SQL}
SELECT page_id, ref, count(*) AS n FROM refs
WHERE trim(ref) <> '' AND NOT regexp_matches(trim(ref), '^[/#]') AND NOT regexp_matches(trim(ref), '^[A-Za-z][A-Za-z0-9+.-]*:') GROUP BY ALL""")
def html_refs(spark, sf_dir):
    """Links of whole pages; their root-relative links are made relative first."""
    mapping = {"a": "href", **W.ASSET_ATTRIBUTES}
    html = F.replace(F.col("html"), F.lit('href="/'), F.lit('href="'))
    pages = V.table(spark, sf_dir, "pages").select("page_id", F.explode(W.html_refs(html, mapping)).alias("ref"))
    return pages.groupBy("page_id", "ref").agg(F.count("*").alias("n"))


@query("relative_ref", f"""WITH {LINK_SQL}
SELECT page_id, ref, trim(ref) <> '' AND NOT regexp_matches(trim(ref), '^[/#]') AND NOT regexp_matches(trim(ref), '^[A-Za-z][A-Za-z0-9+.-]*:') AS relative
FROM (SELECT DISTINCT page_id, ref FROM (SELECT page_id, ref FROM refs UNION ALL SELECT page_id, substr(ref, 2) FROM refs))""")
def relative_ref(spark, sf_dir):
    mapping = {"a": "href", **W.ASSET_ATTRIBUTES}
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    values = F.transform(W.html_tags(F.col("html"), list(mapping)), lambda t: W.attribute(t, names[W.tag_name(t)]))
    both = F.concat(values, F.transform(values, lambda v: F.substring(v, F.lit(2), F.length(v))))
    refs = V.table(spark, sf_dir, "pages").select("page_id", F.explode(both).alias("ref")).distinct()
    return refs.select("page_id", "ref", W.relative_ref(F.col("ref")).alias("relative"))


@query("css_refs", """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS u, url FROM pages)
SELECT page_id, u AS ref, 2 AS n FROM p WHERE trim(u) <> '' AND NOT regexp_matches(u, '^[/#]')
UNION ALL SELECT page_id, 'fonts/' || page_id || '.woff', 1 FROM p
UNION ALL SELECT page_id, 'end/' || page_id || '.png', 1 FROM p""")
def css_refs(spark, sf_dir):
    """Style sheets written from page addresses, with strings, absolute targets and the page as a comment."""
    pages = V.table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    sheet = F.concat(
        F.lit('/* url(no.png) */ @import "'), path, F.lit('";\n.a{background:url( '), path,
        F.lit(" )} .b{content:\"url(no.png)\"}\n@import '"), "url", F.lit("'; .c{src:URL('fonts/"),
        F.col("page_id").cast("string"), F.lit(".woff')}\n/*"), F.replace(F.col("html"), F.lit("*/"), F.lit("")),
        F.lit("*/ .d{background:url(end/"), F.col("page_id").cast("string"), F.lit(".png)}"),
    )
    refs = pages.select("page_id", F.explode(W.css_refs(sheet)).alias("ref"))
    return refs.groupBy("page_id", "ref").agg(F.count("*").cast("int").alias("n"))


def code(spark, sf_dir):
    """Files and source lines as tables."""
    files = materialize_once(
        spark, f"code-files {sf_dir}", lambda: V.documents(spark, sf_dir).select(*KEY, "path")
    )
    return files, C.source_lines(spark, sf_dir)


@query("import_refs_line", f"""WITH {C.LINKS}, spec AS (
  SELECT change_id, i AS file_idx, unnest(CASE
    WHEN l = 'go' THEN CASE WHEN td = '' AND m % 2 = 0 THEN [] WHEN m % 2 = 0 THEN [td] ELSE ['example.com/mod/' || td] END
    WHEN l = 'python' AND m = 0 THEN [replace(tt, '/', '.')] WHEN l = 'python' AND m = 1 THEN ['os', replace(ts, '/', '.')]
    WHEN l = 'python' AND m = 2 THEN ['.' || split_part(tt, '/', -1)] WHEN l = 'python' THEN ['...' || replace(tt, '/', '.')]
    WHEN l IN ('java', 'kotlin') AND m = 3 THEN CASE WHEN td = '' THEN [] ELSE [td || '/*'] END
    WHEN l IN ('java', 'kotlin') THEN ['org/acme/' || replace(ts, '.', '/')] ELSE [] END) AS specifier FROM links)
SELECT DISTINCT change_id, file_idx, specifier FROM spec""")
def import_refs_line(spark, sf_dir):
    files, lines = code(spark, sf_dir)
    return I.import_refs_line(I.with_language(lines.where("t = 'a'"), files)).distinct()


@query("import_refs_js", f"""WITH {C.LINKS}
SELECT DISTINCT change_id, i AS file_idx, CASE m WHEN 0 THEN tt WHEN 1 THEN ts WHEN 2 THEN '@app/' || ts ELSE up || tp END AS specifier
FROM links WHERE l = 'javascript'""")
def import_refs_js(spark, sf_dir):
    files, lines = code(spark, sf_dir)
    return I.import_refs_js(I.with_language(lines, files)).distinct()


@query("exported_defs", f"""WITH {C.LINKS}
SELECT change_id, file_idx, CASE l WHEN 'go' THEN 'Sym_' ELSE 'sym_' END || doc_id AS symbol FROM cf WHERE l IN ('javascript', 'go', 'python', 'java', 'kotlin')
UNION SELECT change_id, file_idx, CASE l WHEN 'go' THEN 'Shared_helper' ELSE 'shared_helper' END FROM cf WHERE l IN ('javascript', 'go', 'python') AND file_idx % 7 = 0""")
def exported_defs(spark, sf_dir):
    return I.exported_defs(*code(spark, sf_dir))


@query("identifier_tokens", f"""WITH {O.LINES}
SELECT DISTINCT change_id, file_idx, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS symbol FROM lines WHERE t = 'a'""")
def identifier_tokens(spark, sf_dir):
    return I.identifier_tokens(V.lines(spark, sf_dir))


@query("tf_facts", f"""WITH {C.LINKS}, t AS (SELECT * FROM cf WHERE l = 'terraform'), u AS (SELECT * FROM links WHERE l = 'terraform')
SELECT change_id, file_idx, dir, 'define' AS role, 'variable' AS kind, '' AS type_name, 'v_' || doc_id AS name FROM t
UNION SELECT change_id, file_idx, dir, 'define', 'resource', 'aws_thing', 'r_' || doc_id FROM t
UNION SELECT change_id, file_idx, dir, 'define', 'local', '', 'l_' || doc_id FROM t
UNION SELECT change_id, file_idx, dir, 'define', 'local', '', 'b_' || doc_id FROM t
UNION SELECT change_id, file_idx, dir, 'refer', 'variable', '', 'v_' || doc_id FROM t
UNION SELECT change_id, file_idx, dir, 'refer', 'local', '', 'l_' || doc_id FROM t
UNION SELECT change_id, i, sd, 'define', 'module', '', 'm' || i || '_' || j FROM u WHERE m = 1
UNION SELECT change_id, i, sd, 'source', 'module', '', './' FROM u WHERE m = 1
UNION SELECT change_id, i, sd, 'refer', 'resource', 'aws_thing', 'r_' || dj FROM u WHERE m = 3
UNION SELECT change_id, i, sd, 'refer', 'variable', '', 'v_' || dj FROM u WHERE m IN (0, 2)""")
def tf_facts(spark, sf_dir):
    return TR.tf_facts(*code(spark, sf_dir))


HEADER_SQL = "chr(10) || '===== FILE ' || file_idx || ': \"' || path || '\" (' || status || ', +' || additions || '/-' || deletions || ') =====' || chr(10)"


@query("file_header", f"WITH {O.FILES} SELECT change_id, file_idx, {HEADER_SQL} AS header FROM files")
def file_header(spark, sf_dir):
    return A.headers(V.files(spark, sf_dir)).select(*KEY, "header")


DIFF_SQL = O.FILES + O.HUNKS + f""",
bodies AS (
  SELECT change_id, file_idx, hunk_idx, string_agg(CASE t WHEN 'a' THEN '+' WHEN 'd' THEN '-' ELSE ' ' END || text || chr(10), '' ORDER BY line_idx) AS body
  FROM lines GROUP BY ALL),
texts AS (
  SELECT change_id, file_idx, string_agg('@@ ' || header || chr(10) || body, '' ORDER BY hunk_idx) AS text
  FROM hunks JOIN bodies USING (change_id, file_idx, hunk_idx) GROUP BY ALL),
diffs AS (
  SELECT files.*, {HEADER_SQL} AS header, CASE WHEN "binary" THEN '(binary file)' || chr(10) ELSE coalesce(text, '') END AS diff
  FROM files LEFT JOIN texts USING (change_id, file_idx))"""


def diffs(spark, sf_dir, cap=None):
    lines = V.lines(spark, sf_dir)
    return A.diff_text(lines, V.hunks(lines), V.files(spark, sf_dir).select(*KEY, "binary"), cap)


def cut_sql(text: str, limit: int | str) -> str:
    """The longest prefix within a byte limit: a cut inside a character is no valid text."""
    cuts = ", ".join(f"try(decode(array_slice(encode({text}), 1, greatest({limit} - {k}, 0))))" for k in range(4))
    return f"coalesce({cuts})"


NOTE_SQL = "chr(10) || '... [truncated]' || chr(10)"


@query("diff_text", f"""WITH {DIFF_SQL}
SELECT change_id, file_idx, sha256(diff) AS digest, strlen(diff) AS bytes,
  CASE WHEN strlen(diff) > 200 THEN {cut_sql('diff', 200)} || {NOTE_SQL} ELSE diff END AS outside,
  CASE WHEN strlen(diff) > 120 THEN {cut_sql('diff', 103)} || {NOTE_SQL} ELSE diff END AS inside FROM diffs""")
def diff_text(spark, sf_dir):
    diff = F.col("diff")
    return diffs(spark, sf_dir).select(
        *KEY, F.sha2("diff", 256).alias("digest"), F.octet_length("diff").cast("bigint").alias("bytes"),
        TF.cap_outside(diff, F.lit(200)).alias("outside"), TF.cap_inside(diff, F.lit(120)).alias("inside"),
    )


@query("utf8_truncate", f"""SELECT doc_id, {cut_sql('text', 57)} AS short,
  CASE WHEN strlen(text) <= 34 THEN 'n=' || replace(text, chr(10), ' ') ELSE 'n=' || {cut_sql("replace(text, chr(10), ' ')", 31)} || '...' END AS field FROM documents""")
def utf8_truncate(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", TF.utf8_truncate(F.col("text"), F.lit(57)).alias("short"),
        TF.ellipsis_field("n=", F.col("text"), F.lit(36)).alias("field"),
    )


@query("neutralize", """
SELECT doc_id, sha256(replace(replace(replace(replace(marked, 'BEGIN_UNTRUSTED_' || nonce, '[neutralized]'), 'END_UNTRUSTED_' || nonce, '[neutralized]'),
  'BEGIN_UNTRUSTED_CHANGE_DATA', '[neutralized]'), 'END_UNTRUSTED_CHANGE_DATA', '[neutralized]')) AS digest
FROM (SELECT doc_id, left(sha256(source), 16) AS nonce,
  replace(text, 'e', 'BEGIN_UNTRUSTED_' || CASE WHEN doc_id % 2 = 0 THEN left(sha256(source), 16) ELSE 'CHANGE_DATA' END) || 'END_UNTRUSTED_CHANGE_DATA' AS marked FROM documents)""")
def neutralize(spark, sf_dir):
    nonce = TF.change_nonce(F.col("source"))
    mark = F.concat(F.lit("BEGIN_UNTRUSTED_"), F.when(F.col("doc_id") % 2 == 0, nonce).otherwise("CHANGE_DATA"))
    marked = F.concat(F.replace(F.col("text"), F.lit("e"), mark), F.lit("END_UNTRUSTED_CHANGE_DATA"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.sha2(TF.neutralize(marked, nonce), 256).alias("digest"))


@query("hunk_label", f"""WITH {O.LINES}{O.HUNKS}, seen AS (
  SELECT change_id, file_idx, hunk_idx, arg_min(CASE WHEN new = 0 THEN old ELSE new END, line_idx) AS a, arg_max(CASE WHEN new = 0 THEN old ELSE new END, line_idx) AS b
  FROM lines GROUP BY ALL)
SELECT change_id, file_idx, hunk_idx, CASE WHEN header <> '' THEN header WHEN a = b THEN 'line ' || a ELSE 'lines ' || a || '–' || b END AS label
FROM hunks JOIN seen USING (change_id, file_idx, hunk_idx)""")
def hunk_label(spark, sf_dir):
    lines = V.lines(spark, sf_dir)
    return A.hunk_label(V.hunks(lines), lines)


PAIR_SQL = O.LINES + """,
turns AS (SELECT *, CASE WHEN t <> lag(t, 1, t) OVER (PARTITION BY change_id, file_idx, hunk_idx ORDER BY line_idx) THEN 1 ELSE 0 END AS turn FROM lines),
isl AS (SELECT *, sum(turn) OVER (PARTITION BY change_id, file_idx, hunk_idx ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS island FROM turns),
placed AS (SELECT *, row_number() OVER w AS at, count(*) OVER (PARTITION BY change_id, file_idx, hunk_idx, island) AS size FROM isl
  WINDOW w AS (PARTITION BY change_id, file_idx, hunk_idx, island ORDER BY line_idx)),
pairs AS (
  SELECT d.change_id, d.file_idx, d.hunk_idx, d.line_idx AS old_line, a.line_idx AS new_line, d.text AS o, a.text AS n
  FROM placed d JOIN placed a ON d.change_id = a.change_id AND d.file_idx = a.file_idx AND d.hunk_idx = a.hunk_idx
   AND a.island = d.island + 1 AND a.at = d.at WHERE d.t = 'd' AND a.t = 'a')"""

# Common prefix and suffix by testing every length; spans widened to whole words.
SPAN_SQL = """,
longest AS (SELECT max(length(text)) AS top FROM lines),
pre AS (
  SELECT *, (SELECT count(*) FROM range(1, least(length(o), length(n)) + 1) r(k) WHERE left(o, k) = left(n, k)) AS p
  FROM {pairs} WHERE o <> n AND length(o) <= 4096 AND length(n) <= 4096),
suf AS (
  SELECT *, (SELECT count(*) FROM range(1, least(length(o), length(n)) - p + 1) r(k) WHERE right(o, k) = right(n, k)) AS s FROM pre),
content AS (
  SELECT *, length(regexp_replace(left(o, p), '\\s', '', 'g')) + CASE WHEN s = 0 THEN 0 ELSE length(regexp_replace(right(o, s), '\\s', '', 'g')) END AS common,
         least(length(regexp_replace(o, '\\s', '', 'g')), length(regexp_replace(n, '\\s', '', 'g'))) AS shorter FROM suf),
start_at AS (
  SELECT *, p - CASE WHEN regexp_matches(substr(o, p + 1, 1) || substr(n, p + 1, 1), '[\\p{{L}}\\p{{Nd}}_]')
                 THEN length(regexp_extract(left(o, p), '[\\p{{L}}\\p{{Nd}}_]*$')) ELSE 0 END AS start FROM content
  WHERE shorter = 0 OR common / shorter >= 0.5),
end_at AS (
  SELECT *, s - CASE WHEN s > 0 AND ((length(o) - s > start AND regexp_matches(substr(o, length(o) - s, 1), '[\\p{{L}}\\p{{Nd}}_]'))
                       OR (length(n) - s > start AND regexp_matches(substr(n, length(n) - s, 1), '[\\p{{L}}\\p{{Nd}}_]')))
                 THEN length(regexp_extract(right(o, s), '^[\\p{{L}}\\p{{Nd}}_]*')) ELSE 0 END AS keep FROM start_at)
"""

NEIGHBOUR_SQL = """
pairs AS (
  SELECT change_id, file_idx, pos, text AS o, CASE WHEN pos % 2 = 0 THEN replace(text, 'er', 'x') ELSE left(text, length(text) // 2) || ' new ' || right(text, length(text) - length(text) // 2) END AS n
  FROM lines)"""


@query("changed_spans", "WITH " + O.LINES + "," + NEIGHBOUR_SQL + SPAN_SQL.format(pairs="pairs") + """
SELECT change_id, file_idx, pos, CAST(start AS INTEGER) AS start, CAST(length(o) - keep AS INTEGER) AS old_end, CAST(length(n) - keep AS INTEGER) AS new_end FROM end_at""")
def changed_spans(spark, sf_dir):
    """Every line against an edited copy of itself."""
    text = F.col("text")
    half = F.floor(F.length(text) / 2).cast("int")
    edited = F.when(F.col("pos") % 2 == 0, F.replace(text, F.lit("er"), F.lit("x"))).otherwise(
        F.concat(F.substring(text, F.lit(1), half), F.lit(" new "), F.substring(text, half + 1, F.length(text)))
    )
    pairs = V.lines(spark, sf_dir).select(*KEY, F.col("pos").cast("bigint").alias("pos"), "text", edited.alias("edited"))
    rows = TF.changed_spans(
        pairs, "text", "edited", DEFAULTS.long_line_threshold, DEFAULTS.word_diff_min_similarity
    )
    return rows.select(*KEY, "pos", "start", "old_end", "new_end")


@query("image_kind", f"""WITH {O.DOCS}, e AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS x FROM docs)
SELECT change_id, file_idx, x IN ('.png', '.jpg', '.jpeg', '.gif', '.webp', '.svg') AS image, 'image/png' AS mime FROM e""")
def image_kind(spark, sf_dir):
    path = F.col("path")
    return V.documents(spark, sf_dir).select(
        *KEY, PF.image_kind(path, DEFAULTS.image_extensions).alias("image"), PF.image_mime(path).alias("mime")
    )


SIZES = "o_orderkey * o_orderkey % 9000017 - 3000"
LABEL_SQL = """CASE WHEN abs({x}) < 1000 THEN abs({x}) || ' B' WHEN abs({x}) < 1000000 THEN printf('%.1f KB', abs({x}) / 1000.0::DOUBLE) ELSE printf('%.1f MB', abs({x}) / 1000000.0::DOUBLE) END"""


@query("size_label", f"""WITH s AS (SELECT o_orderkey, {SIZES} AS delta FROM orders)
SELECT o_orderkey, {LABEL_SQL.format(x='delta')} AS size, CASE WHEN delta < 0 THEN '-' ELSE '+' END || {LABEL_SQL.format(x='delta')} AS change FROM s""")
def size_label(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SIZES).alias("delta"))
    return orders.select(
        "o_orderkey", TF.size_label(F.abs("delta")).alias("size"), TF.delta_label(F.col("delta")).alias("change")
    )


@query("safe_name", """
SELECT page_id, CASE WHEN s = '' THEN 'review' ELSE s END AS name FROM (
  SELECT page_id, regexp_replace(regexp_replace(CASE WHEN page_id % 9 = 0 THEN ' .-. ' ELSE url || '..' END, '[^A-Za-z0-9_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS s FROM pages)""")
def safe_name(spark, sf_dir):
    raw = F.when(F.col("page_id") % 9 == 0, " .-. ").otherwise(F.concat("url", F.lit("..")))
    return V.table(spark, sf_dir, "pages").select("page_id", PF.safe_name(raw).alias("name"))


@query("repo_identity", """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '^([^/]+/[^/]+)', 1) AS slug, url FROM pages)
SELECT page_id, CASE WHEN slug = '' THEN '' ELSE lower(host) || '/' || slug END AS identity FROM p""")
def repo_identity(spark, sf_dir):
    """Page addresses as URL or scp-like remotes, by page number."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    short = F.regexp_extract(path, r"^([^/]+/[^/]+)", 1)
    remote = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" git@"), F.upper(host), F.lit(":"), short, F.lit(".git ")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("ssh://git@"), host, F.lit(":22/"), short, F.lit(".git")))
        .otherwise(F.col("url"))
    )
    return V.table(spark, sf_dir, "pages").select("page_id", PF.repo_identity(remote).alias("identity"))


@query("collapse_flag", f"WITH {O.FILES} SELECT change_id, file_idx, additions + deletions > 20 AS collapsed FROM files")
def collapse_flag(spark, sf_dir):
    return V.files(spark, sf_dir).select(*KEY, A.collapse_flag(20).alias("collapsed"))


@query("key_symbol_cap", f"""WITH {O.LINES}, w AS (
  SELECT DISTINCT change_id, file_idx, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) AS symbol FROM lines WHERE t = 'a'),
r AS (SELECT *, row_number() OVER (PARTITION BY change_id, file_idx ORDER BY symbol) AS k FROM w)
SELECT change_id, file_idx, string_agg(symbol, ',' ORDER BY k) AS symbols FROM r WHERE k <= 5 GROUP BY ALL""")
def key_symbol_cap(spark, sf_dir):
    tokens = I.identifier_tokens(V.lines(spark, sf_dir))
    symbols = tokens.groupBy(*KEY).agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))
    return symbols.select(*KEY, F.array_join(A.key_symbol_cap(F.col("symbols")), ",").alias("symbols"))


