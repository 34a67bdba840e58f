"""The derived tables of ``views`` restated in SQL, as common table expressions."""

from __future__ import annotations

from changeloom.plans.views import ENDINGS, FOLDERS


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


DOCS = f"""
docs0 AS (
  SELECT doc_id, lang, text, change_id, plain,
         CAST(row_number() OVER (PARTITION BY change_id ORDER BY doc_id, plain DESC) - 1 AS INTEGER) AS file_idx
  FROM (SELECT doc_id, lang, text, source AS change_id, true AS plain FROM documents
        UNION ALL SELECT doc_id, lang, text, source, false FROM documents WHERE doc_id % 17 = 0 OR doc_id % 11 = 2)),
docs1 AS (
  SELECT *, {sql_list(FOLDERS)}[file_idx % 16 + 1] AS folder,
         {sql_list(ENDINGS)}[file_idx % 16 + 1] AS ending,
         CASE doc_id % 11 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS status,
         NOT plain AND doc_id % 17 = 0 AS "binary", doc_id % 23 = 0 AS mode_changed
  FROM docs0),
docs2 AS (
  SELECT *, CASE WHEN folder = '' THEN '' ELSE folder || '/' || lang || '/' END || CASE WHEN plain THEN 'doc_' ELSE 'copy_' END || doc_id || ending AS path,
         CASE WHEN status <> 'renamed' THEN 0 WHEN plain THEN 90 ELSE 100 END AS similarity
  FROM docs1),
docs AS (
  SELECT *, CASE WHEN status = 'renamed' THEN 'old/' || path ELSE path END AS old_path, path AS new_path
  FROM docs2)"""

LINES = DOCS + """,
lines0 AS (
  SELECT change_id, file_idx, doc_id, status, unnest(string_split(text, chr(10))) AS text,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM docs WHERE plain),
lines1 AS (
  SELECT *, CASE WHEN status = 'added' THEN 'a' WHEN status = 'deleted' THEN 'd'
                 WHEN (doc_id * 31 + pos) % 7 <= 1 THEN 'd' WHEN (doc_id * 31 + pos) % 7 <= 3 THEN 'a'
                 ELSE 'c' END AS t
  FROM lines0),
lines AS (
  SELECT change_id, file_idx, doc_id, CAST(pos // 40 AS INTEGER) AS hunk_idx, CAST(pos % 40 AS INTEGER) AS line_idx, t,
         CAST(CASE WHEN t = 'a' THEN 0 ELSE count(*) FILTER (t <> 'a') OVER w END AS INTEGER) AS old,
         CAST(CASE WHEN t = 'd' THEN 0 ELSE count(*) FILTER (t <> 'd') OVER w END AS INTEGER) AS new,
         text, pos
  FROM lines1
  WINDOW w AS (PARTITION BY change_id, file_idx ORDER BY pos ROWS UNBOUNDED PRECEDING))"""

FILES = LINES + """,
churn AS (
  SELECT change_id, file_idx, count(*) FILTER (t = 'a') AS a, count(*) FILTER (t = 'd') AS d, max(hunk_idx) + 1 AS h
  FROM lines GROUP BY ALL),
files AS (
  SELECT docs.change_id, docs.file_idx, doc_id, path, old_path, new_path, status, "binary", similarity, mode_changed,
         CAST(coalesce(a, 0) AS INTEGER) AS additions, CAST(coalesce(d, 0) AS INTEGER) AS deletions,
         CAST(coalesce(h, 0) AS INTEGER) AS hunk_count
  FROM docs LEFT JOIN churn USING (change_id, file_idx))"""

HUNKS = """,
hunks AS (
  SELECT change_id, file_idx, hunk_idx,
         coalesce(min(nullif(old, 0)), 0) AS old_start, CAST(count(*) FILTER (t <> 'a') AS INTEGER) AS old_count,
         coalesce(min(nullif(new, 0)), 0) AS new_start, CAST(count(*) FILTER (t <> 'd') AS INTEGER) AS new_count,
         CASE WHEN hunk_idx % 2 = 0 THEN 'block ' || hunk_idx ELSE '' END AS header
  FROM lines GROUP BY change_id, file_idx, hunk_idx)"""

EDGES = """,
edge0 AS (SELECT change_id, file_idx AS i, CAST(count(*) OVER (PARTITION BY change_id) AS INTEGER) AS n FROM docs),
edges AS (
  SELECT change_id, i AS importer, (i * 7 + 3) % (i + 1) AS imported FROM edge0 WHERE i % 3 = 0 AND i <> (i * 7 + 3) % (i + 1)
  UNION
  SELECT change_id, i, (i * 5 + 1) % (i + 1) FROM edge0 WHERE i % 4 = 0 AND i <> (i * 5 + 1) % (i + 1)
  UNION
  SELECT change_id, i, i - 16 FROM edge0 WHERE i >= 16
  UNION
  SELECT change_id, i, (i + 1) % n FROM edge0 WHERE i % 10 = 3 AND i <> (i + 1) % n
  UNION
  SELECT change_id, i, i - 1 FROM edge0 WHERE i % 20 = 4
  UNION
  SELECT change_id, i, (i + 16) % n FROM edge0 WHERE i % 50 = 25 AND i <> (i + 16) % n)"""

ATTRS = """,
attrs AS (
  SELECT change_id, path, 'linguist-generated' AS attribute,
         CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'set' WHEN toxic = 1 THEN 'TRUE'
              WHEN quality = 1 THEN 'unspecified' ELSE 'unset' END AS value
  FROM docs JOIN labels USING (doc_id)),
generated AS (SELECT DISTINCT change_id, path FROM attrs WHERE lower(value) IN ('set', 'true'))"""

BLAME = """,
blame AS (
  SELECT change_id, path, CAST(event_id % 10 * 4 + 1 AS INTEGER) AS line, sha1(CAST(event_id AS VARCHAR)) AS "commit",
         'user ' || user_id AS author, epoch_us(ts) // 1000000 - 60 AS author_ts, '+0000' AS author_tz,
         CASE WHEN event_id % 7 = 0 THEN 0 ELSE epoch_us(ts) // 1000000 END AS committer_ts,
         CASE event_id % 3 WHEN 0 THEN '+0530' WHEN 1 THEN '-0800' ELSE '+0000' END AS committer_tz, event_id AS seq
  FROM events JOIN docs ON docs.doc_id = event_id // 10)"""

RESPONSES = """
answers0 AS (
  SELECT conv_id, turn,
         '{"index": ' || turn % 6 || ', "summary": "' ||
         CASE WHEN conv_id % 5 = 3 THEN text
              ELSE replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') END ||
         '", "layerHint": "' || ['schema','backend','api','ui','tests','docs','misc'][(conv_id + turn) % 7 + 1] ||
         '", "keySymbols": ["sym_' || conv_id || '"]}' AS body
  FROM conversations),
answers AS (
  SELECT conv_id, turn,
         CASE conv_id % 5
           WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'Done.'
           WHEN 2 THEN 'Sure. ' || body || ' That is all.'
           WHEN 4 THEN left(body, length(body) - 12)
           ELSE body END AS raw
  FROM answers0),
fenced AS (
  SELECT *, CASE WHEN instr(raw, '```') > 0 THEN string_split(regexp_replace(raw, '^(?s:.*?)```[^\\n]*\\n', ''), '```')[1]
                 ELSE raw END AS inner_text
  FROM answers),
candidates AS (
  SELECT conv_id, turn, raw,
         nullif(regexp_extract(inner_text, '(?s:\\{.*\\})'), '') AS candidate
  FROM fenced),
parsed AS (
  SELECT *, CASE WHEN candidate IS NULL THEN 'failed' WHEN json_valid(candidate) THEN 'ok'
                 WHEN json_valid(replace(candidate, chr(10), '\\n')) THEN 'repaired' ELSE 'failed' END AS status,
         CASE WHEN candidate IS NULL THEN NULL WHEN json_valid(candidate) THEN candidate
              WHEN json_valid(replace(candidate, chr(10), '\\n')) THEN replace(candidate, chr(10), '\\n') END AS good
  FROM candidates)"""

CLAIMS = """,
claim0 AS (SELECT change_id, file_idx AS i, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS c FROM docs),
claims AS (
  SELECT change_id, c AS cohort_idx, i AS pos, i AS file_idx FROM claim0 WHERE i % 10 <> 3
  UNION ALL SELECT change_id, (c + 1) % 5, i + 5000, i FROM claim0 WHERE i % 9 = 4
  UNION ALL SELECT change_id, c, i + 9000, i + 100000 FROM claim0 WHERE i % 13 = 5),
claim_cohorts AS (
  SELECT change_id, g AS cohort_idx, 'Cohort ' || g AS title, ['schema','backend','mystery','tests','docs'][g + 1] AS layer,
         [greatest(g - 1, 0), greatest(g - 2, 0), 4, 0] AS depends_on
  FROM (SELECT DISTINCT change_id FROM docs), (SELECT CAST(unnest(range(5)) AS INTEGER) AS g)),
sizes AS (SELECT change_id, CAST(count(*) AS INTEGER) AS n FROM docs GROUP BY change_id)"""

ASSETS = """
assets AS (
  SELECT 'pages-' || page_id // 25 AS change_id, CAST(page_id % 25 AS INTEGER) AS file_idx,
         regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) || '/p' || page_id || ['.png','.jpg','.bin','.svg','.gif'][page_id % 5 + 1] AS path,
         CASE page_id % 6 WHEN 0 THEN 'deleted' WHEN 1 THEN 'added' ELSE 'modified' END AS status,
         CASE WHEN page_id % 6 <> 1 AND page_id % 10 <> 9 THEN strlen(html) * (page_id % 7 + 1) // 2 END AS old_size,
         CASE WHEN page_id % 6 <> 0 AND page_id % 10 <> 8 THEN strlen(html) END AS new_size
  FROM pages)"""

CACHE = """
entries AS (
  SELECT sha256(text) AS key, 'entries/' || doc_id || '.json' AS path, doc_id * 7919 % 1009 AS mtime,
         CASE WHEN doc_id % 5 = 0 THEN 5 ELSE 6 END AS schema_version,
         CASE WHEN doc_id % 7 <> 0 THEN doc_id % 2 = 0 END AS staged, doc_id
  FROM documents)"""

LAYER_CASE = """CASE
  WHEN regexp_matches(lower({p}), 'migration|schema|\\.sql$|models?/') THEN 'schema'
  WHEN regexp_matches(lower({p}), 'test|spec|__tests__|\\.test\\.|\\.spec\\.') THEN 'tests'
  WHEN regexp_matches(lower({p}), 'routes?|api|controller|endpoint|graphql|resolver') THEN 'api'
  WHEN regexp_matches(lower({p}), 'component|page|view|\\.css|\\.scss|\\.html$|frontend|ui/|\\.tsx$|\\.jsx$|\\.vue$') THEN 'ui'
  WHEN regexp_matches(lower({p}), '\\.(json|ya?ml|toml|ini|env|cfg)$|dockerfile|makefile|\\.github/') THEN 'config'
  WHEN regexp_matches(lower({p}), '\\.(md|rst|txt)$|docs?/') THEN 'docs'
  ELSE 'backend' END"""

LANGUAGE_CASE = """CASE
  WHEN regexp_matches(lower({p}), '\\.(js|jsx|ts|tsx|mjs|cjs|mts|cts)$') THEN 'javascript'
  WHEN lower({p}) LIKE '%.go' THEN 'go' WHEN lower({p}) LIKE '%.py' THEN 'python'
  WHEN lower({p}) LIKE '%.java' THEN 'java' WHEN regexp_matches(lower({p}), '\\.kts?$') THEN 'kotlin'
  WHEN lower({p}) LIKE '%.tf' THEN 'terraform' WHEN regexp_matches(lower({p}), '\\.html?$') THEN 'html'
  WHEN lower({p}) LIKE '%.css' THEN 'css' END"""


def layer(column: str) -> str:
    return LAYER_CASE.format(p=column)


def language(column: str) -> str:
    return LANGUAGE_CASE.format(p=column)
