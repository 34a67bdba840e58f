"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.operators import aggregate as A
from changeloom.plans import oracle_views as O
from changeloom.plans import views as V
from changeloom.plans.registry import query
from changeloom.settings import DEFAULTS
from changeloom.sources import patches as P
from changeloom.sources import responses as R
from changeloom.sources import tables as T
from changeloom.sources.shared import new_path

SECTION_SQL = O.FILES + O.HUNKS + """,
pieces AS (
  SELECT change_id, file_idx, hunk_idx,
         '@@ -' || old_start || ',' || old_count || ' +' || new_start || ',' || new_count || ' @@' ||
         CASE WHEN header = '' THEN '' ELSE ' ' || header END || chr(10) || body AS hunk
  FROM hunks JOIN (
    SELECT change_id, file_idx, hunk_idx,
           string_agg(CASE t WHEN 'a' THEN '+' WHEN 'd' THEN '-' ELSE ' ' END || text, chr(10) ORDER BY line_idx) AS body
    FROM lines GROUP BY ALL) USING (change_id, file_idx, hunk_idx)),
sections AS (
  SELECT files.change_id, files.file_idx, files.path,
    'diff --git a/' || old_path || ' b/' || new_path ||
    CASE WHEN mode_changed THEN chr(10) || 'old mode 100644' || chr(10) || 'new mode 100755' ELSE '' END ||
    CASE status WHEN 'added' THEN chr(10) || 'new file mode 100644' WHEN 'deleted' THEN chr(10) || 'deleted file mode 100644'
      WHEN 'renamed' THEN chr(10) || 'similarity index ' || similarity || '%' || chr(10) || 'rename from ' || old_path || chr(10) || 'rename to ' || new_path
      ELSE '' END ||
    CASE WHEN "binary" THEN chr(10) || 'Binary files a/' || old_path || ' and b/' || new_path || ' differ'
      ELSE chr(10) || '--- a/' || old_path || chr(10) || '+++ b/' || new_path END ||
    CASE WHEN hunk_text IS NULL THEN '' ELSE chr(10) || hunk_text END AS section
  FROM files LEFT JOIN (
    SELECT change_id, file_idx, string_agg(hunk, chr(10) ORDER BY hunk_idx) AS hunk_text FROM pieces GROUP BY ALL)
  USING (change_id, file_idx))
"""


@query("read_patches", "WITH " + SECTION_SQL + """
SELECT path, len(string_split(section, chr(10))) AS n_lines, strlen(section) AS n_bytes, sha256(section) AS digest
FROM sections""")
def read_patches(spark, sf_dir):
    """Write the rendered patches to shared storage, read them back section by section."""
    target = new_path(spark, "patches")
    V.patch_text(spark, sf_dir).select("section").write.text(target)
    # The written files end with a line break which belongs to the file, not the section.
    section = F.regexp_replace("section", r"\n\z", "")
    rows = P.read_patches(spark, target).withColumn("section", section)
    return P.parse_files(rows.withColumn("text", section)).select(
        "path",
        F.size(F.split("text", "\n")).alias("n_lines"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("digest"),
    )


@query("parse_files", "WITH " + O.FILES + """
SELECT change_id, file_idx, path, old_path, new_path, status, "binary", similarity, mode_changed FROM files""")
def parse_files(spark, sf_dir):
    return P.parse_files(V.patch_text(spark, sf_dir)).drop("doc_id", "header_ok")


@query("parse_hunks", "WITH " + O.LINES + O.HUNKS + """
SELECT change_id, file_idx, hunk_idx, header, CAST(old_start AS BIGINT) AS old_start, CAST(old_count AS BIGINT) AS old_count,
       CAST(new_start AS BIGINT) AS new_start, CAST(new_count AS BIGINT) AS new_count FROM hunks""")
def parse_hunks(spark, sf_dir):
    return P.parse_hunks(V.patch_text(spark, sf_dir))


@query("parse_lines", "WITH " + O.LINES + """
SELECT change_id, file_idx, hunk_idx, line_idx, t, CAST(old AS BIGINT) AS old, CAST(new AS BIGINT) AS new, text FROM lines""")
def parse_lines(spark, sf_dir):
    return P.parse_lines(V.patch_text(spark, sf_dir))


@query("parse_errors", "WITH " + O.DOCS + """
SELECT change_id, 'header' AS rule,
       'parse diff header: ' || replace('a/' || old_path || ' b/' || new_path, ' b/', ' ') || ' extra' AS detail
FROM docs WHERE doc_id % 19 = 3""")
def parse_errors(spark, sf_dir):
    """Every nineteenth header is damaged: the separator is lost and a third field added."""
    damaged = F.regexp_replace("section", r"^(diff --git [^\n]*?) b/([^\n]*)", "$1 $2 extra")
    broken = V.patch_text(spark, sf_dir).withColumn(
        "section", F.when(F.col("doc_id") % 19 == 3, damaged).otherwise(F.col("section"))
    )
    return P.parse_errors(broken)


@query("read_change_meta", """
SELECT 'pr-' || o_orderkey AS name, 'PR #' || o_orderkey || ': ' || o_orderpriority AS title,
       'Total ' || o_custkey AS description, 'main ← topic-' || o_custkey AS "range",
       'https://code.example.com/team' || o_custkey % 7 || '/repo.git/pull/' || o_orderkey AS url,
       'code.example.com/team' || o_custkey % 7 || '/repo' AS repo
FROM orders""")
def read_change_meta(spark, sf_dir):
    """Orders written as pull request records, read back with the fixed schema."""
    orders = V.table(spark, sf_dir, "orders")
    records = orders.select(
        F.col("o_orderkey").cast("int").alias("number"),
        F.col("o_orderpriority").alias("title"),
        F.format_string("Total %d", "o_custkey").alias("body"),
        F.lit("main").alias("baseRefName"),
        F.format_string("topic-%d", "o_custkey").alias("headRefName"),
        F.format_string("https://code.example.com/team%d/repo.git/pull/%d", F.col("o_custkey") % 7, "o_orderkey").alias("url"),
    )
    target = new_path(spark, "pull-requests")
    records.write.json(target)
    return T.read_change_meta(spark, target)


@query("snapshot_status", """
WITH base AS (SELECT doc_id, source AS change_id, 'f/' || doc_id AS path, sha256(text) AS digest FROM documents),
old AS (SELECT change_id, path, digest FROM base WHERE doc_id % 7 <> 0),
new AS (SELECT change_id, CASE WHEN doc_id % 6 = 1 THEN 'moved/' || doc_id ELSE path END AS path,
               CASE WHEN doc_id % 4 = 0 THEN sha256(digest) ELSE digest END AS digest FROM base WHERE doc_id % 5 <> 0),
deleted AS (SELECT change_id, path, digest FROM old WHERE (change_id, path) NOT IN (SELECT change_id, path FROM new)),
added AS (SELECT change_id, path, digest FROM new WHERE (change_id, path) NOT IN (SELECT change_id, path FROM old)),
d1 AS (SELECT change_id, digest, min(path) AS path FROM deleted GROUP BY ALL HAVING count(*) = 1),
a1 AS (SELECT change_id, digest, min(path) AS path FROM added GROUP BY ALL HAVING count(*) = 1),
renames AS (SELECT d1.change_id, d1.path AS old_path, a1.path AS new_path FROM d1 JOIN a1 USING (change_id, digest))
SELECT change_id, new_path AS path, old_path, 'renamed' AS status, 100 AS similarity FROM renames
UNION ALL SELECT change_id, path, path, 'deleted', 0 FROM deleted WHERE (change_id, path) NOT IN (SELECT change_id, old_path FROM renames)
UNION ALL SELECT change_id, path, path, 'added', 0 FROM added WHERE (change_id, path) NOT IN (SELECT change_id, new_path FROM renames)
UNION ALL SELECT change_id, path, path, 'modified', 0 FROM old JOIN new USING (change_id, path) WHERE old.digest <> new.digest""")
def snapshot_status(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    base = docs.select(
        "doc_id", F.col("source").alias("change_id"),
        F.format_string("f/%d", "doc_id").alias("path"), F.sha2("text", 256).alias("digest"),
    )
    old = base.where("doc_id % 7 <> 0").drop("doc_id")
    new = base.where("doc_id % 5 <> 0").select(
        "change_id",
        F.when(F.col("doc_id") % 6 == 1, F.format_string("moved/%d", "doc_id")).otherwise(F.col("path")).alias("path"),
        F.when(F.col("doc_id") % 4 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"),
    )
    return T.snapshot_status(old, new)


# A moved file keeps its text but for the lines of every fifth position, or is cut in half.
SIDES_SQL = """
sided AS (
  SELECT doc_id, source AS change_id, 'gone/' || doc_id AS old_path, 'come/' || doc_id AS new_path, unnest(string_split(text, chr(10))) AS text,
         unnest(range(len(string_split(text, chr(10))))) AS pos, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 3 = 0),
gone AS (SELECT change_id, old_path AS path, text FROM sided),
come AS (SELECT change_id, new_path AS path, CASE WHEN pos % 5 = 4 THEN 'new ' || text ELSE text END AS text FROM sided WHERE doc_id % 4 > 0 OR pos < n // 2)"""


@query("similar_renames", f"""WITH RECURSIVE {SIDES_SQL},
g AS (SELECT change_id, path, text, count(*) AS n FROM gone GROUP BY ALL),
c AS (SELECT change_id, path, text, count(*) AS n FROM come GROUP BY ALL),
gs AS (SELECT change_id, path, sum(n * (strlen(text) + 1)) AS size FROM g GROUP BY ALL),
cs AS (SELECT change_id, path, sum(n * (strlen(text) + 1)) AS size FROM c GROUP BY ALL),
pair AS (SELECT g.change_id, g.path AS old_path, c.path AS path, sum(least(g.n, c.n) * (strlen(g.text) + 1)) AS shared
  FROM g JOIN c USING (change_id, text) GROUP BY ALL),
scored AS (SELECT pair.change_id, pair.old_path, pair.path, CAST(100 * shared // greatest(gs.size, cs.size) AS INTEGER) AS similarity FROM pair
  JOIN gs ON gs.change_id = pair.change_id AND gs.path = old_path JOIN cs ON cs.change_id = pair.change_id AND cs.path = pair.path
  WHERE 100 * shared >= 60 * greatest(gs.size, cs.size)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY similarity DESC, old_path, path) AS k FROM scored),
folded AS (
  SELECT change_id, 0 AS k, CAST([] AS VARCHAR[]) AS used, false AS took FROM (SELECT DISTINCT change_id FROM ranked)
  UNION ALL
  SELECT f.change_id, r.k, CASE WHEN list_has_any(f.used, [r.old_path, r.path]) THEN f.used ELSE list_concat(f.used, [r.old_path, r.path]) END, NOT list_has_any(f.used, [r.old_path, r.path])
  FROM folded f JOIN ranked r ON r.change_id = f.change_id AND r.k = f.k + 1)
SELECT change_id, old_path, path, similarity FROM ranked JOIN folded USING (change_id, k) WHERE took""")
def similar_renames(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(
        "doc_id", F.col("source").alias("change_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"),
        F.size(F.split("text", "\n")).alias("n"),
    )
    gone = docs.select("change_id", F.format_string("gone/%d", "doc_id").alias("path"), "text")
    come = docs.where("doc_id % 4 > 0 OR pos < n div 2").select(
        "change_id", F.format_string("come/%d", "doc_id").alias("path"),
        F.when(F.col("pos") % 5 == 4, F.concat(F.lit("new "), "text")).otherwise(F.col("text")).alias("text"),
    )
    return T.similar_renames(gone, come, 60)


@query("read_attributes", "WITH " + O.DOCS + O.ATTRS + " SELECT change_id, path FROM generated")
def read_attributes(spark, sf_dir):
    return T.generated_paths(V.attributes(spark, sf_dir))


@query("attr_join", "WITH " + O.DOCS + O.ATTRS + """
SELECT change_id, file_idx, path FROM docs WHERE (change_id, path) IN (SELECT change_id, path FROM generated)""")
def attr_join(spark, sf_dir):
    files = V.documents(spark, sf_dir).select("change_id", "file_idx", "path")
    return T.attr_join(files, V.attributes(spark, sf_dir))


def blame_reports(spark, sf_dir):
    record = F.concat(
        "commit", F.lit(" 1 "), F.col("line").cast("string"), F.lit("\nauthor "), "author",
        F.lit("\nauthor-time "), F.col("author_ts").cast("string"), F.lit("\nauthor-tz "), "author_tz",
        F.lit("\ncommitter someone\ncommitter-time "), F.col("committer_ts").cast("string"),
        F.lit("\ncommitter-tz "), "committer_tz", F.lit("\nsummary change\n\tline text\n"),
    )
    rows = V.blame(spark, sf_dir).withColumn("record", record)
    return rows.groupBy("change_id", "path").agg(A.ordered_text(["seq"], "record").alias("report"))


@query("read_blame", "WITH " + O.DOCS + O.BLAME + """
SELECT change_id, path, CAST(row_number() OVER (PARTITION BY change_id, path ORDER BY seq) - 1 AS INTEGER) AS seq,
       "commit", line, author, author_ts, author_tz, committer_ts, committer_tz FROM blame""")
def read_blame(spark, sf_dir):
    return T.read_blame(blame_reports(spark, sf_dir))


SIZE_SQL = """CASE WHEN {x} < 1000 THEN {x} || ' B' WHEN {x} < 1000000 THEN printf('%.1f KB', {x} / 1000.0)
  ELSE printf('%.1f MB', {x} / 1000000.0) END"""


@query("asset_inventory", "WITH " + O.ASSETS + f""",
labelled AS (
  SELECT *, regexp_matches(lower(path), '\\.(png|jpg|jpeg|gif|webp|svg)$') AS image,
    {SIZE_SQL.format(x='old_size')} AS o, {SIZE_SQL.format(x='new_size')} AS n,
    CASE WHEN new_size < old_size THEN '-' ELSE '+' END || {SIZE_SQL.format(x='abs(new_size - old_size)')} AS d
  FROM assets)
SELECT change_id, file_idx, path, status, image, old_size, new_size,
  CASE WHEN image THEN 'Binary image' ELSE 'Binary file' END || ' · ' ||
  CASE WHEN (status <> 'deleted' AND new_size IS NULL) OR (status <> 'added' AND old_size IS NULL) THEN 'one or more sides unavailable'
       WHEN status = 'added' THEN 'added ' || n WHEN status = 'deleted' THEN 'deleted ' || o
       ELSE o || ' → ' || n || ' (' || d || ')' END AS label
FROM labelled""")
def asset_inventory(spark, sf_dir):
    rows = V.assets(spark, sf_dir)
    files = rows.select(
        "change_id", "file_idx", "path", "status", F.lit(True).alias("binary"),
        F.col("path").alias("old_path"), F.col("path").alias("new_path"),
    )
    old = rows.where("old_size is not null").select("change_id", "path", F.col("old_size").alias("size"))
    new = rows.where("new_size is not null").select("change_id", "path", F.col("new_size").alias("size"))
    return T.asset_inventory(files, old, new)


@query("read_responses", "WITH " + O.RESPONSES + " SELECT conv_id, turn, candidate FROM candidates")
def read_responses(spark, sf_dir):
    return R.read_responses(V.responses(spark, sf_dir)).drop("raw")


@query("repair_responses", "WITH " + O.RESPONSES + """
SELECT conv_id, turn, status, CAST(good ->> '$.index' AS INTEGER) AS "index", good ->> '$.summary' AS summary,
       good ->> '$.layerHint' AS layer_hint, good ->> '$.keySymbols[0]' AS symbol FROM parsed""")
def repair_responses(spark, sf_dir):
    candidates = R.read_responses(V.responses(spark, sf_dir)).drop("raw")
    answer = F.col("answer")
    return R.repair_responses(candidates, R.SUMMARY_SCHEMA).select(
        "conv_id", "turn", "status", answer["index"].alias("index"), answer["summary"].alias("summary"),
        answer["layerHint"].alias("layer_hint"), answer["keySymbols"][0].alias("symbol"),
    )


CACHE_SQL = "WITH " + O.CACHE + """,
newest AS (
  SELECT key, path, staged FROM entries WHERE schema_version = 6 AND staged IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY mtime DESC, path DESC) = 1)
SELECT e.doc_id, e.key, newest.path AS entry_path, newest.staged AS entry_staged, newest.key IS NOT NULL AS cached
FROM entries e LEFT JOIN newest USING (key)"""


@query("cache_table", CACHE_SQL)
def cache_table(spark, sf_dir):
    entries = V.cache_entries(spark, sf_dir)
    return T.cache_lookup(entries.select("doc_id", "key"), entries.drop("doc_id"))


@query("cache_store", CACHE_SQL)
def cache_store(spark, sf_dir):
    """Entries appended to a store on disk in two rounds, then looked up by every document."""
    entries = V.cache_entries(spark, sf_dir)
    stored, root = entries.drop("doc_id"), new_path(spark, "cache")
    for late in (False, True):
        T.append_cache(stored.where((F.col("mtime") % 2 == 1) == late), root)
    requests = entries.select("doc_id", "key")
    return T.cache_lookup(requests, T.asked_entries(spark, root, stored.schema, requests))


@query("cache_prune", "WITH " + O.CACHE + """
SELECT store, key, path, mtime FROM (SELECT entries.*, source AS store FROM entries JOIN documents USING (doc_id))
QUALIFY row_number() OVER (PARTITION BY store ORDER BY mtime DESC, path DESC) <= 200""")
def cache_prune(spark, sf_dir):
    """One store per source."""
    stores = V.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("store"))
    entries = V.cache_entries(spark, sf_dir).join(stores, "doc_id").select("store", "key", "path", "mtime")
    return T.cache_prune(entries, DEFAULTS.cache_max_entries, ["store"])


def catalog(spark, sf_dir):
    prs = V.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).cast("int").alias("repository"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"),
        F.unix_timestamp("o_orderdate").alias("updated_at"),
    )
    branches = V.table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 20).cast("int").alias("repository"), F.format_string("branch-%d", "c_custkey").alias("name"), F.lit("origin/branch-7").alias("base"),
        (F.col("c_custkey") % 4).alias("ahead"), F.col("c_custkey").alias("committed_at"),
        F.col("c_name").alias("subject"),
    )
    commits = V.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).cast("int").alias("repository"), F.sha1(F.col("event_id").cast("string")).alias("hash"),
        F.substring(F.sha1(F.col("event_id").cast("string")), 1, 7).alias("short_hash"),
        F.unix_timestamp("ts").alias("committed_at"), F.col("event_type").alias("subject"),
    )
    return T.catalog_scan(prs, branches, commits)


CATALOG_SQL = """
catalog AS (
  SELECT CAST(o_custkey % 20 AS INTEGER) AS repository, 'pr' AS kind, '#' || o_orderkey || '  ' || o_orderpriority AS label, o_orderkey || ' ' || o_orderpriority AS search,
         CAST(o_orderkey AS VARCHAR) AS ref, epoch_us(o_orderdate) // 1000000 AS sort_key
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate DESC, o_orderkey DESC) <= 1000
  UNION ALL
  SELECT CAST(c_custkey % 20 AS INTEGER), 'branch', 'branch-' || c_custkey || '  (' || c_custkey % 4 || ' ahead)  ' || c_name, 'branch-' || c_custkey || ' ' || c_name,
         'branch-' || c_custkey, c_custkey FROM customer WHERE c_custkey % 4 > 0 AND c_custkey <> 7
  UNION ALL
  SELECT r, 'commit', left(h, 7) || '  ' || event_type, h || ' ' || left(h, 7) || ' ' || event_type, h, s
  FROM (SELECT CAST(user_id % 20 AS INTEGER) AS r, sha1(CAST(event_id AS VARCHAR)) AS h, event_type, epoch_us(ts) // 1000000 AS s FROM events)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY s DESC, h DESC) <= 1000)"""


@query("catalog_scan", "WITH " + CATALOG_SQL + " SELECT * FROM catalog")
def catalog_scan(spark, sf_dir):
    return catalog(spark, sf_dir)


@query("catalog_search", "WITH " + CATALOG_SQL + """
SELECT repository, kind, position, label, ref, greatest(matches - 8, 0) AS hidden FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repository, kind ORDER BY sort_key DESC, ref) AS INTEGER) AS position, count(*) OVER (PARTITION BY repository, kind) AS matches
  FROM catalog WHERE contains(lower(search || ' ' || label), 'e'))
WHERE position <= 8""")
def catalog_search(spark, sf_dir):
    return T.catalog_search(catalog(spark, sf_dir), " E ")


@query("match_remote", """
WITH p AS (SELECT page_id, page_id // 10 AS repo, url, lower(regexp_extract(url, '^https?://([^/]+)', 1)) || '/' || nullif(regexp_extract(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '^([^/]+/[^/]+)', 1), '') AS identity FROM pages),
remotes AS (SELECT repo, page_id, 'remote' || page_id AS remote, coalesce(identity, '') AS identity FROM p WHERE page_id % 3 = 0 AND (repo % 2 = 0 OR page_id % 10 < 3)),
per AS (SELECT repo, count(*) AS n, max(remote) AS single FROM remotes GROUP BY repo),
firsts AS (SELECT repo, identity, min_by(remote, page_id) AS m FROM remotes GROUP BY ALL)
SELECT p.page_id AS change_id, coalesce(f.m, CASE WHEN n = 1 THEN single END) AS remote,
  CASE WHEN coalesce(f.m, CASE WHEN n = 1 THEN single END) IS NOT NULL THEN NULL
       WHEN n IS NULL THEN 'local repository has no git remotes'
       ELSE 'no git remote matches PR repository ' || coalesce(p.identity, '') END AS error
FROM p LEFT JOIN firsts f ON p.repo = f.repo AND p.identity = f.identity LEFT JOIN per ON p.repo = per.repo""")
def match_remote(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages").select(
        "page_id", F.expr("page_id div 10").alias("repo"), "url"
    )
    remotes = pages.where("page_id % 3 = 0 AND (repo % 2 = 0 OR page_id % 10 < 3)").select(
        "repo", F.col("page_id").alias("pos"), F.format_string("remote%d", "page_id").alias("remote"), "url"
    )
    return T.match_remote(pages.withColumnRenamed("page_id", "change_id"), remotes)
