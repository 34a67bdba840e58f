"""Queries over joins, aggregations, windows, top-k and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import imports as I
from changeloom.operators import aggregate as A
from changeloom.operators import assemble as S
from changeloom.operators import graph as G
from changeloom.operators import resolve as R
from changeloom.operators import terraform as TR
from changeloom.operators import triage as TG
from changeloom.operators import validate as VA
from changeloom.operators import windows as W
from changeloom.plans import code_view as C
from changeloom.plans import oracle_views as O
from changeloom.plans import views as V
from changeloom.plans.registry import query
from changeloom.plans.scalar_queries import DIFF_SQL, PAIR_SQL, SPAN_SQL, TRIAGED, code, flagged, triaged
from changeloom.settings import DEFAULTS, SCHEMA_VERSION, Settings
from changeloom.sources import responses as RS
from changeloom.sources.shared import materialize, materialize_once

KEY = ["change_id", "file_idx"]
SMALL = Settings(fold_threshold=4, fold_context=1, staging_max_files=8)


@query("churn_by_layer", f"""WITH {O.FILES}
SELECT change_id, {O.layer('path')} AS layer, count(*) AS files, sum(additions) AS additions, sum(deletions) AS deletions FROM files GROUP BY ALL""")
def churn_by_layer(spark, sf_dir):
    """Patch text parsed into files and lines, then churn by layer of each change."""
    from changeloom.functions.paths import classify_layer
    from changeloom.sources import patches as P

    sections = V.patch_text(spark, sf_dir)
    churn = A.file_churn(P.parse_lines(sections))
    files = P.parse_files(sections).select(*KEY, classify_layer(F.col("path")).alias("layer"))
    return files.join(churn, KEY, "left").groupBy("change_id", "layer").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("additions"), F.lit(0)).alias("additions"),
        F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"),
    )


@query("file_churn", f"""WITH {O.LINES}
SELECT change_id, file_idx, CAST(count(*) FILTER (t = 'a') AS INTEGER) AS additions, CAST(count(*) FILTER (t = 'd') AS INTEGER) AS deletions FROM lines GROUP BY ALL""")
def file_churn(spark, sf_dir):
    return A.file_churn(V.lines(spark, sf_dir))


COHORTS_SQL = O.DOCS + f""",
based AS (SELECT change_id, file_idx, path, {O.layer('path')} AS layer,
  CASE WHEN contains(path, '/') THEN string_split(path, '/')[:-2] ELSE ['.'] END AS folders FROM docs),
prefixes AS (SELECT change_id, file_idx, layer, k, array_to_string(folders[:k], '/') AS directory FROM (SELECT *, unnest(range(1, len(folders) + 1)) AS k FROM based)),
counted AS (SELECT *, count(*) OVER (PARTITION BY change_id, layer, directory) AS n FROM prefixes),
fitted AS (SELECT change_id, file_idx, arg_min(directory, k) FILTER (n <= MAXFILES) AS fit FROM counted GROUP BY ALL),
homes AS (SELECT b.change_id, b.file_idx, b.path, b.layer, coalesce(fit, array_to_string(folders, '/')) AS directory, fit IS NULL AS over FROM based b JOIN fitted USING (change_id, file_idx)),
chunks AS (SELECT *, (row_number() OVER (PARTITION BY change_id, layer, directory, over ORDER BY path, file_idx) - 1) // MAXFILES AS chunk,
  (row_number() OVER (PARTITION BY change_id, layer, directory, over ORDER BY path, file_idx) - 1) % MAXFILES AS pos,
  ceil(count(*) OVER (PARTITION BY change_id, layer, directory, over) / MAXFILES) AS total FROM homes),
leads AS (SELECT change_id, layer, directory, over, chunk, min(path) AS lead FROM chunks GROUP BY ALL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY lead, layer, directory, chunk) - 1 AS cohort_idx FROM leads),
cohorts AS (SELECT change_id, CAST(cohort_idx AS INTEGER) AS cohort_idx, CAST(pos AS INTEGER) AS pos, file_idx,
  CASE WHEN directory = '.' THEN 'Root' ELSE directory END || ' ' || layer || ' changes' || CASE WHEN total > 1 THEN ' (' || chunk + 1 || '/' || CAST(total AS INTEGER) || ')' ELSE '' END AS title, layer, directory
  FROM chunks JOIN firsts USING (change_id, layer, directory, over, chunk))"""
# Three files per cohort, so that even changes of fifty files split.
COHORTS3 = COHORTS_SQL.replace("MAXFILES", "3")
AFTER_FILES = COHORTS3.removeprefix(O.DOCS)


def plan_of(spark, sf_dir):
    return W.plan_cohorts(V.documents(spark, sf_dir).select(*KEY, "path"), 3)


def planned(spark, sf_dir):
    """The cohort plan as a table: it is fixed once and read by all later steps."""
    return materialize_once(spark, f"cohorts {sf_dir}", lambda: plan_of(spark, sf_dir))


@query("plan_cohorts", f"WITH {COHORTS3} SELECT * FROM cohorts")
def plan_cohorts(spark, sf_dir):
    return plan_of(spark, sf_dir)


@query("change_totals", f"""WITH {TRIAGED}{AFTER_FILES},
c AS (SELECT change_id, count(DISTINCT cohort_idx) AS cohorts FROM cohorts GROUP BY ALL)
SELECT change_id, count(*) AS files, sum(additions) AS additions, sum(deletions) AS deletions, count(reason) AS mechanical, any_value(c.cohorts) AS cohorts
FROM triaged JOIN c USING (change_id) GROUP BY change_id""")
def change_totals(spark, sf_dir):
    return A.change_totals(triaged(spark, sf_dir), planned(spark, sf_dir))


BYTES_SQL = DIFF_SQL + """,
totals AS (SELECT change_id, sum(strlen(header) + strlen(diff)) AS input_bytes, count(*) AS files, max(strlen(header)) AS max_header FROM diffs GROUP BY change_id)"""


@query("input_bytes", f"WITH {BYTES_SQL} SELECT * FROM totals")
def input_bytes(spark, sf_dir):
    lines = V.lines(spark, sf_dir)
    return A.input_bytes(V.files(spark, sf_dir), lines, V.hunks(lines))


@query("staging_decision", f"""WITH {BYTES_SQL}{AFTER_FILES},
frames AS (SELECT change_id, sum(strlen('COHORT[' || cohort_idx || '] l=' || layer || ' t=xxxx r=xxxx' || chr(10))) AS frame_bytes FROM (SELECT DISTINCT change_id, cohort_idx, layer FROM cohorts) GROUP BY ALL)
SELECT change_id, input_bytes, input_bytes > 900 OR files > 8 AS staged, 64 + greatest(max_header, frame_bytes) AS minimum_budget,
  CASE WHEN (input_bytes > 900 OR files > 8) AND 64 + greatest(max_header, frame_bytes) > 900 THEN 'analysis budget 900 is too small (minimum ' || 64 + greatest(max_header, frame_bytes) || ')' END AS error
FROM totals JOIN frames USING (change_id)""")
def staging_decision(spark, sf_dir):
    return A.staging_decision(input_bytes(spark, sf_dir), planned(spark, sf_dir), 900, 64, SMALL)


@query("unique_definitions", f"""WITH {C.LINKS}, defs AS (
  SELECT change_id, file_idx, CASE l WHEN 'go' THEN 'Sym_' ELSE 'sym_' END || doc_id AS symbol FROM cf WHERE l IN ('javascript', 'go', 'python', 'java', 'kotlin')
  UNION SELECT change_id, file_idx, CASE l WHEN 'go' THEN 'Shared_helper' ELSE 'shared_helper' END FROM cf WHERE l IN ('javascript', 'go', 'python') AND file_idx % 7 = 0)
SELECT change_id, symbol, min(file_idx) AS file_idx FROM defs GROUP BY change_id, symbol HAVING count(*) = 1""")
def unique_definitions(spark, sf_dir):
    return A.unique_definitions(I.exported_defs(*code(spark, sf_dir)))


def queries_of(spark, sf_dir):
    files, lines = code(spark, sf_dir)
    targets = materialize_once(
        spark, f"import-targets {sf_dir}", lambda: R.import_queries(files, I.import_specifiers(files, lines))
    )
    return files, targets


def resolved(spark, sf_dir, via):
    return R.resolve_modules(*queries_of(spark, sf_dir)).where(F.col("via") == via).drop("via")


for _via in ("exact", "suffix", "alias", "platform"):
    def _resolve(spark, sf_dir, via=_via):
        return resolved(spark, sf_dir, via)

    query(f"resolve_{_via}", f"WITH {C.RESOLVED} SELECT DISTINCT change_id, importer, imported FROM resolved WHERE via = '{_via}'")(_resolve)


@query("resolve_directory", f"WITH {C.RESOLVED} SELECT change_id, importer, imported FROM packaged")
def resolve_directory(spark, sf_dir):
    return R.resolve_directory(*queries_of(spark, sf_dir)).drop("via")


@query("symbol_edges", f"WITH {C.RESOLVED} SELECT DISTINCT change_id, importer, imported FROM symbolic")
def symbol_edges(spark, sf_dir):
    files, lines = code(spark, sf_dir)
    return R.symbol_edges(I.exported_defs(files, lines), I.identifier_tokens(lines, I.MIN_SYMBOL_BYTES))


@query("tf_edges", f"WITH {C.RESOLVED} SELECT DISTINCT change_id, importer, imported FROM terraformed")
def tf_edges(spark, sf_dir):
    files, lines = code(spark, sf_dir)
    return TR.tf_edges(files, materialize(TR.tf_facts(files, lines), "terraform-facts"))


@query("build_edges", f"WITH {C.RESOLVED} SELECT change_id, importer, imported FROM built")
def build_edges(spark, sf_dir):
    return R.build_edges(*code(spark, sf_dir))


OFFSET_SQL = "CASE zone WHEN '+0530' THEN 19800 WHEN '-0800' THEN -28800 ELSE 0 END"
AUTHOR_SQL = """,
stamped AS (SELECT *, CASE WHEN committer_ts = 0 THEN author_ts ELSE committer_ts END AS stamp, CASE WHEN committer_ts = 0 THEN author_tz ELSE committer_tz END AS zone FROM {rows}),
newest AS (SELECT * FROM stamped QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY stamp DESC, seq DESC) = 1)
SELECT {key}, author, strftime(make_timestamp((stamp + {offset}) * 1000000), '%Y-%m-%dT%H:%M:%S') ||
  CASE zone WHEN '+0530' THEN '+05:30' WHEN '-0800' THEN '-08:00' ELSE 'Z' END AS date FROM newest"""


@query("latest_author", "WITH " + O.DOCS + O.BLAME + AUTHOR_SQL.format(rows="blame", key="change_id, path", offset=OFFSET_SQL))
def latest_author(spark, sf_dir):
    return A.latest_author(V.blame(spark, sf_dir), ["change_id", "path"])


@query("blame_hunks", "WITH " + O.LINES + O.BLAME + """,
spans AS (SELECT change_id, file_idx, hunk_idx, min(new) AS a, max(new) AS b FROM lines WHERE new > 0 GROUP BY ALL),
hits AS (SELECT s.change_id, s.file_idx, s.hunk_idx, b.author, b.author_ts, b.author_tz, b.committer_ts, b.committer_tz, b.seq
  FROM spans s JOIN docs d ON d.change_id = s.change_id AND d.file_idx = s.file_idx AND NOT "binary" AND d.status <> 'deleted'
  JOIN blame b ON b.change_id = s.change_id AND b.path = d.path AND b.line BETWEEN s.a AND s.b)"""
       + AUTHOR_SQL.format(rows="hits", key="change_id, file_idx, hunk_idx", offset=OFFSET_SQL))
def blame_hunks(spark, sf_dir):
    return A.blame_hunks(V.documents(spark, sf_dir), V.lines(spark, sf_dir), V.blame(spark, sf_dir))


def summaries(spark, sf_dir):
    return V.documents(spark, sf_dir, text=True).select(
        *KEY, F.col("text").alias("summary"),
        F.array(F.format_string("sym_%d", "doc_id"), F.lit("main")).alias("key_symbols"),
    )


STUBS_SQL = "'Change in ' || path || ' (' || status || ', +' || additions || '/-' || deletions || '); no model summary was available.'"


@query("cohort_digest", f"""WITH {TRIAGED}{AFTER_FILES},
cands AS (
  SELECT c.cohort_idx, f.*, row_number() OVER (PARTITION BY f.change_id, c.cohort_idx ORDER BY CASE WHEN flags = '' THEN 1 ELSE 0 END, -(additions + deletions), f.path, f.file_idx) AS rank,
    '- FILE ' || file_idx || ' PATH="' || f.path || '" (+' || additions || '/-' || deletions || ') FLAGS=' || replace(flags, '; ', ', ') || ' KEY_SYMBOLS="sym_' || f.doc_id || ', main" SUMMARY="' ||
    replace(replace(replace(replace(replace(replace(replace(replace(d.text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') || '"' || chr(10) AS row
  FROM flagged f JOIN cohorts c USING (change_id, file_idx) JOIN docs d USING (change_id, file_idx) WHERE reason IS NULL),
summed AS (SELECT *, sum(strlen(row)) OVER (PARTITION BY change_id, cohort_idx ORDER BY rank) AS spent FROM cands),
counts AS (
  SELECT change_id, cohort_idx, 'COHORT: ' || any_value(title) || chr(10) || 'LAYER: ' || any_value(layer) || chr(10) || 'DIRECTORY: ' || any_value(directory) || chr(10) ||
   'FILES: ' || count(*) || chr(10) || 'REVIEW_WORTHY: ' || count(*) FILTER (reason IS NULL) || chr(10) || 'MECHANICAL: ' || count(reason) || chr(10) ||
   'FLAGGED: ' || count(*) FILTER (reason IS NULL AND flags <> '') || chr(10) || 'ADDITIONS: ' || sum(additions) || chr(10) || 'DELETIONS: ' || sum(deletions) || chr(10) || 'SAMPLED_SUMMARIES:' || chr(10) AS head
  FROM flagged JOIN cohorts USING (change_id, file_idx) GROUP BY ALL)
SELECT change_id, cohort_idx, any_value(head) || coalesce(string_agg(row, '' ORDER BY rank) FILTER (strlen(head) + spent <= {DEFAULTS.digest_max_chars} AND rank <= {DEFAULTS.digest_max_files}), '') AS digest
FROM counts LEFT JOIN summed USING (change_id, cohort_idx) GROUP BY change_id, cohort_idx""")
def cohort_digest(spark, sf_dir):
    marked = materialize_once(spark, f"flagged {sf_dir}", lambda: flagged(spark, sf_dir))
    return A.cohort_digest(planned(spark, sf_dir), marked, summaries(spark, sf_dir), DEFAULTS.stage_budget)


@query("cohort_stub", f"""WITH {O.FILES}{AFTER_FILES}
SELECT change_id, cohort_idx, any_value(title) AS title, count(*) || ' files, +' || sum(additions) || '/-' || sum(deletions) || '; no model narration was available.' AS intent,
  count(*) || ' files, +' || sum(additions) || '/-' || sum(deletions) || '; no model narration was available.' AS narrative
FROM cohorts JOIN files USING (change_id, file_idx) GROUP BY change_id, cohort_idx""")
def cohort_stub(spark, sf_dir):
    return A.cohort_stub(planned(spark, sf_dir), V.files(spark, sf_dir))


@query("file_stub", f"""WITH {TRIAGED}
SELECT change_id, file_idx, CASE WHEN reason IS NULL THEN {STUBS_SQL} ELSE path || ': ' || reason || '; model analysis was deliberately skipped.' END AS summary,
  {O.layer('path')} AS layer_hint, reason IS NULL AS stubbed FROM triaged""")
def file_stub(spark, sf_dir):
    return A.file_stub(triaged(spark, sf_dir))


@query("content_key", """SELECT doc_id, sha256(strlen(text) || ':' || text || '5:model' || strlen(lang) || ':' || lang || '1:6' || '64:' || sha256('{"budget":' || doc_id || ',"lang":"' || lang || '"}')) AS key FROM documents""")
def content_key(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    settings = F.sha2(F.to_json(F.struct(F.col("doc_id").alias("budget"), "lang")), 256)
    parts = [F.col("text"), F.lit("model"), F.col("lang"), F.lit(SCHEMA_VERSION), settings]
    return docs.select("doc_id", A.content_key(parts).alias("key"))


@query("doc_id", f"""WITH {O.FILES}
SELECT change_id, left(sha256(change_id || chr(0) || '6' || chr(0) || string_agg(path || chr(0) || additions || chr(0) || deletions || chr(0), '' ORDER BY file_idx)), 16) AS doc_id
FROM files GROUP BY change_id""")
def doc_id(spark, sf_dir):
    files = V.files(spark, sf_dir)
    changes = files.select("change_id").distinct().withColumn("range", F.col("change_id"))
    return A.doc_id(files, changes)


WEIGHTS_SQL = COHORTS3 + O.EDGES + """,
ce AS (SELECT DISTINCT e.change_id, e.importer, e.imported, a.cohort_idx AS dependent, b.cohort_idx AS dependency
  FROM edges e JOIN cohorts a ON a.change_id = e.change_id AND a.file_idx = e.importer JOIN cohorts b ON b.change_id = e.change_id AND b.file_idx = e.imported),
weights AS (SELECT change_id, dependent, dependency, count(*) AS weight FROM ce GROUP BY ALL)"""


@query("cohort_edge_join", f"WITH {WEIGHTS_SQL} SELECT * FROM ce")
def cohort_edge_join(spark, sf_dir):
    return G.cohort_edge_join(V.edges(spark, sf_dir), planned(spark, sf_dir))


@query("cohort_weights", f"WITH {WEIGHTS_SQL} SELECT * FROM weights")
def cohort_weights(spark, sf_dir):
    return A.cohort_weights(cohort_edge_join(spark, sf_dir))


@query("top3_deps", f"""WITH {WEIGHTS_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY change_id, dependent ORDER BY weight DESC, dependency) AS INTEGER) AS rank FROM weights)
SELECT change_id, dependent AS cohort_idx, rank, dependency AS dep_idx FROM r WHERE rank <= 3""")
def top3_deps(spark, sf_dir):
    return G.top3_deps(cohort_weights(spark, sf_dir))


@query("cohort_deps", f"""WITH {WEIGHTS_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY change_id, dependent ORDER BY weight DESC, dependency) AS INTEGER) AS rank FROM weights WHERE dependency < dependent)
SELECT change_id, dependent AS cohort_idx, rank, dependency AS dep_idx FROM r WHERE rank <= 3""")
def cohort_deps(spark, sf_dir):
    return G.cohort_deps(V.edges(spark, sf_dir), planned(spark, sf_dir))


RUNS_SQL = O.LINES + """,
st AS (SELECT *, CASE WHEN t = 'a' AND coalesce(lag(t) OVER (PARTITION BY change_id, file_idx, hunk_idx ORDER BY line_idx), 'x') <> 'a' THEN 1 ELSE 0 END AS s FROM lines),
runs AS (SELECT *, CAST(sum(s) OVER (PARTITION BY change_id, file_idx, hunk_idx ORDER BY line_idx) - 1 AS INTEGER) AS run_idx FROM st)"""


@query("added_runs", f"WITH {RUNS_SQL} SELECT change_id, file_idx, hunk_idx, run_idx, line_idx, text FROM runs WHERE t = 'a'")
def added_runs(spark, sf_dir):
    return W.added_runs(V.lines(spark, sf_dir))


@query("pair_changed_lines", "WITH " + PAIR_SQL + SPAN_SQL.format(pairs="pairs") + """
SELECT change_id, file_idx, hunk_idx, old_line, new_line, CAST(start AS INTEGER) AS start, CAST(length(o) - keep AS INTEGER) AS old_end, CAST(length(n) - keep AS INTEGER) AS new_end FROM end_at""")
def pair_changed_lines(spark, sf_dir):
    return W.pair_changed_lines(V.lines(spark, sf_dir))


@query("fold_context", f"""WITH {PAIR_SQL}
SELECT change_id, file_idx, hunk_idx, line_idx, CAST(CASE WHEN "at" = 2 THEN size - 2 ELSE 0 END AS INTEGER) AS fold_count
FROM placed WHERE t = 'c' AND size > 2 AND "at" > 1 AND "at" <= size - 1""")
def fold_context(spark, sf_dir):
    return W.fold_context(V.lines(spark, sf_dir), Settings(fold_threshold=2, fold_context=1))


@query("step_nav", f"""WITH {COHORTS3}
SELECT change_id, cohort_idx, file_idx, CAST(row_number() OVER w AS INTEGER) AS position, CAST(count(*) OVER (PARTITION BY change_id, cohort_idx) AS INTEGER) AS total,
  coalesce(lag(file_idx) OVER w, -1) AS prev_file, coalesce(lead(file_idx) OVER w, -1) AS next_file FROM cohorts WINDOW w AS (PARTITION BY change_id, cohort_idx ORDER BY pos)""")
def step_nav(spark, sf_dir):
    return W.step_nav(planned(spark, sf_dir))


ASSIGN_SQL = O.DOCS + O.CLAIMS + """,
valid AS (SELECT * FROM claims JOIN sizes USING (change_id) WHERE file_idx BETWEEN 0 AND n - 1),
held AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY change_id, file_idx ORDER BY cohort_idx, pos) = 1),
assigned AS (SELECT change_id, file_idx, cohort_idx AS old_idx, CAST(dense_rank() OVER (PARTITION BY change_id ORDER BY cohort_idx) - 1 AS INTEGER) AS cohort_idx,
  CAST(row_number() OVER (PARTITION BY change_id, cohort_idx ORDER BY pos, file_idx) - 1 AS INTEGER) AS pos FROM held)"""


def sizes(spark, sf_dir):
    return V.documents(spark, sf_dir).groupBy("change_id").agg(F.count("*").cast("int").alias("n"))


def assigned(spark, sf_dir):
    return W.first_assignment(V.claims(spark, sf_dir), sizes(spark, sf_dir))


@query("first_assignment", f"WITH {ASSIGN_SQL} SELECT * FROM assigned")
def first_assignment(spark, sf_dir):
    return assigned(spark, sf_dir)


@query("leftover_files", f"""WITH {ASSIGN_SQL}, last AS (SELECT change_id, max(cohort_idx) + 1 AS cohort_idx FROM assigned GROUP BY ALL)
SELECT change_id, last.cohort_idx, CAST(row_number() OVER (PARTITION BY change_id ORDER BY file_idx) - 1 AS INTEGER) AS pos, file_idx, 'Other changes' AS title, 'other' AS layer,
  'No model summary was available for this file.' AS summary
FROM docs JOIN last USING (change_id) WHERE (change_id, file_idx) NOT IN (SELECT change_id, file_idx FROM assigned)""")
def leftover_files(spark, sf_dir):
    return S.leftover_files(V.documents(spark, sf_dir).select(*KEY), assigned(spark, sf_dir))


@query("remap_deps", f"""WITH {ASSIGN_SQL}, numbers AS (SELECT DISTINCT change_id, old_idx, cohort_idx FROM assigned),
deps AS (SELECT change_id, cohort_idx AS old_idx, unnest(depends_on) AS old_dep, unnest(range(len(depends_on))) AS p FROM claim_cohorts),
named AS (SELECT d.change_id, a.cohort_idx, b.cohort_idx AS dep_idx, min(p) AS p FROM deps d JOIN numbers a ON a.change_id = d.change_id AND a.old_idx = d.old_idx
  JOIN numbers b ON b.change_id = d.change_id AND b.old_idx = d.old_dep WHERE b.cohort_idx < a.cohort_idx GROUP BY ALL)
SELECT change_id, cohort_idx, dep_idx, CAST(row_number() OVER (PARTITION BY change_id, cohort_idx ORDER BY p) - 1 AS INTEGER) AS rank FROM named""")
def remap_deps(spark, sf_dir):
    deps = V.claim_cohorts(spark, sf_dir).select(
        "change_id", F.col("cohort_idx").alias("old_idx"), F.posexplode("depends_on").alias("pos", "old_dep")
    )
    numbers = assigned(spark, sf_dir).select("change_id", "old_idx", "cohort_idx").distinct()
    return S.remap_deps(deps, numbers)


@query("flag_join", f"""WITH {TRIAGED}
SELECT change_id, file_idx, path, (change_id, file_idx) NOT IN (SELECT change_id, file_idx FROM lines) AS stubbed, reason IS NOT NULL AS mechanical FROM triaged""")
def flag_join(spark, sf_dir):
    files = triaged(spark, sf_dir)
    stubbed = files.select(*KEY).join(V.lines(spark, sf_dir).select(*KEY), KEY, "left_anti")
    return S.flag_join(files.select(*KEY, "path"), stubbed, files.where("reason IS NOT NULL"))


@query("prefix_budget", f"""WITH {DIFF_SQL}, r AS (
  SELECT change_id, file_idx, strlen(diff) AS size, row_number() OVER w - 1 AS rank, sum(strlen(diff)) OVER w AS spent FROM diffs WHERE NOT "binary" AND strlen(diff) <= 6000
  WINDOW w AS (PARTITION BY change_id ORDER BY strlen(diff), path, file_idx ROWS UNBOUNDED PRECEDING))
SELECT change_id, file_idx, size, CAST(rank AS INTEGER) AS rank, spent FROM r WHERE spent <= 6000""")
def prefix_budget(spark, sf_dir):
    lines = V.lines(spark, sf_dir)
    files = V.files(spark, sf_dir).where("NOT binary")
    sized = files.join(A.diff_bytes(lines, V.hunks(lines)), KEY, "left").select(
        *KEY, "path", F.coalesce("diff_bytes", F.lit(0)).alias("size")
    ).where("size <= 6000")
    return W.prefix_budget(sized, ["change_id"], ["size", "path", "file_idx"], "size", 6000).drop("path")


@query("flat_chunks", f"""WITH {O.DOCS}, r AS (SELECT change_id, file_idx, row_number() OVER (PARTITION BY change_id ORDER BY path, file_idx) - 1 AS k, count(*) OVER (PARTITION BY change_id) AS n FROM docs)
SELECT change_id, file_idx, CAST(k // 8 + 1 AS INTEGER) AS chunk, CAST(ceil(n / 8) AS INTEGER) AS total, CAST(k % 8 AS INTEGER) AS pos FROM r""")
def flat_chunks(spark, sf_dir):
    docs = V.documents(spark, sf_dir).select(*KEY, "path")
    return W.flat_chunks(docs, ["change_id"], ["path", "file_idx"], 8).drop("path")


@query("sort_files", f"WITH {O.DOCS} SELECT change_id, path, file_idx FROM docs ORDER BY change_id, path, file_idx")
def sort_files(spark, sf_dir):
    return TG.sort_files(V.documents(spark, sf_dir).select("change_id", "path", "file_idx"))


@query("dedupe_notes", """
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') AS notes
FROM (SELECT doc_id, string_split(text, chr(10)) || string_split(replace(text, ' ', chr(10)), chr(10)) AS w FROM documents)""")
def dedupe_notes(spark, sf_dir):
    """Lines of each text, then its words."""
    notes = S.dedupe_notes(F.split("text", "\n"), F.split("text", "[ \n]"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(notes, "|").alias("notes"))


@query("validate_membership", f"""WITH {O.DOCS}{O.CLAIMS},
counts AS (SELECT c.change_id, c.cohort_idx, c.layer, count(k.pos) AS claimed FROM claim_cohorts c LEFT JOIN claims k USING (change_id, cohort_idx) GROUP BY ALL),
deps AS (SELECT change_id, cohort_idx, unnest(depends_on) AS d FROM claim_cohorts),
valid AS (SELECT change_id, file_idx, count(*) AS times FROM claims JOIN sizes USING (change_id) WHERE file_idx BETWEEN 0 AND n - 1 GROUP BY ALL)
SELECT change_id, 'layer' AS rule, 'cohorts[' || cohort_idx || '].layer is not in the allowed enum' AS detail FROM counts WHERE layer = 'mystery'
UNION ALL SELECT change_id, 'empty', 'cohorts[' || cohort_idx || '].files must not be empty' FROM counts WHERE claimed = 0
UNION ALL SELECT change_id, 'parallel', 'cohorts[' || cohort_idx || '].fileSummaries must be parallel to files' FROM counts WHERE claimed <> 3
UNION ALL SELECT change_id, 'range', 'cohorts[' || cohort_idx || '].files contains out-of-range index ' || file_idx FROM claims JOIN sizes USING (change_id) WHERE file_idx >= n
UNION ALL SELECT change_id, 'dependency', 'cohorts[' || cohort_idx || '].dependsOn contains ' || d || ', which is not an earlier cohort' FROM deps WHERE d >= cohort_idx
UNION ALL SELECT change_id, 'duplicate', 'file index ' || file_idx || ' is assigned to multiple cohorts' FROM valid WHERE times > 1
UNION ALL SELECT change_id, 'unassigned', 'file index ' || file_idx || ' is not assigned to a cohort' FROM docs WHERE (change_id, file_idx) NOT IN (SELECT change_id, file_idx FROM valid)""")
def validate_membership(spark, sf_dir):
    cohorts = V.claim_cohorts(spark, sf_dir)
    deps = cohorts.select("change_id", "cohort_idx", F.explode("depends_on").alias("dep_idx"))
    counted = cohorts.select("change_id", "cohort_idx", "layer", F.lit(3).alias("summary_count"))
    return VA.validate_membership(sizes(spark, sf_dir), counted, V.claims(spark, sf_dir), deps)


@query("validate_complete", f"""WITH {TRIAGED}{AFTER_FILES}, sizes AS (SELECT change_id, count(*) AS n FROM docs GROUP BY ALL),
mech AS (SELECT change_id, file_idx AS idx FROM triaged WHERE reason IS NOT NULL UNION ALL SELECT change_id, file_idx FROM triaged WHERE reason = 'binary' AND file_idx % 2 = 0),
stub AS (SELECT change_id, CASE WHEN file_idx % 5 = 0 THEN file_idx + 1000 ELSE file_idx END AS idx FROM triaged WHERE doc_id % 6 = 0)
SELECT change_id, 'range' AS rule, 'stubbedFiles contains out-of-range index ' || idx AS detail FROM stub JOIN sizes USING (change_id) WHERE idx >= n
UNION ALL SELECT change_id, 'duplicate', 'mechanicalFiles contains duplicate index ' || idx FROM mech GROUP BY change_id, idx HAVING count(*) = 2
UNION ALL SELECT change_id, 'disjoint', 'file index ' || idx || ' cannot be both stubbed and mechanical' FROM mech JOIN stub USING (change_id, idx)
UNION ALL SELECT change_id, 'symbols', 'fileKeySymbols must be parallel to files' FROM sizes WHERE n % 2 = 1
UNION ALL SELECT change_id, 'range', 'stubbedCohorts contains out-of-range index 9999' FROM sizes""")
def validate_complete(spark, sf_dir):
    """Planned cohorts with wrong index lists around them."""
    files = triaged(spark, sf_dir)
    changes = sizes(spark, sf_dir)
    placed = planned(spark, sf_dir)
    cohorts = placed.groupBy("change_id", "cohort_idx").agg(
        F.first("layer").alias("layer"), F.count("*").alias("summary_count")
    )
    no_deps = placed.where("false").select("change_id", "cohort_idx", F.col("pos").alias("dep_idx"))
    membership = VA.validate_membership(changes, cohorts, placed, no_deps)
    mechanical = files.where("reason IS NOT NULL").select("change_id", F.col("file_idx").alias("idx"))
    again = files.where("reason = 'binary' AND file_idx % 2 = 0").select("change_id", F.col("file_idx").alias("idx"))
    shifted = F.when(F.col("file_idx") % 5 == 0, F.col("file_idx") + 1000).otherwise(F.col("file_idx"))
    stubbed = files.where("doc_id % 6 = 0").select("change_id", shifted.alias("idx"))
    symbols = changes.select("change_id", (F.floor(F.col("n") / 2) * 2).alias("listed"), F.lit(0).alias("missing"))
    bad_cohorts = changes.select("change_id", F.lit(9999).alias("idx"))
    return VA.validate_complete(
        membership, changes, cohorts, stubbed, mechanical.unionByName(again), symbols, bad_cohorts
    )


CONTENT = """CASE doc_id % 4 WHEN 0 THEN '{"title": "t", "overview": " ", "cohorts": []}'
  WHEN 1 THEN '{"title": "", "overview": "o", "cohorts": [{"title": "c", "layer": "api", "intent": "", "narrative": "n", "files": [1], "fileSummaries": ["s"], "reviewNotes": []}]}'
  WHEN 2 THEN '{"title": "t", "overview": "o", "cohorts": [{"title": "c", "layer": "api", "intent": "i", "narrative": "n", "files": [1], "fileSummaries": ["s"], "reviewNotes": [], "dependsOn": []}]}'
  ELSE '{"title": "t", "overview": "o"}' END"""


@query("validate_content", """
SELECT CAST(doc_id AS VARCHAR) AS change_id, 'blank' AS rule, 'overview must not be empty' AS detail FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'no_cohorts', 'cohorts must contain at least one item' FROM documents WHERE doc_id % 4 IN (0, 3)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'blank', 'title must not be empty' FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'blank', 'cohorts[0].intent must not be empty' FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'missing', 'cohorts[0].dependsOn must be present' FROM documents WHERE doc_id % 4 = 1""")
def validate_content(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("change_id"), F.expr(CONTENT).alias("raw"))
    parsed = docs.select("change_id", RS.strict_json(F.col("raw"), RS.ANALYSIS_SCHEMA).alias("a"))
    return VA.validate_content(parsed.select("change_id", "a.title", "a.overview", "a.cohorts"))


ANSWER_SQL = O.RESPONSES + """,
returned AS (SELECT conv_id, CAST(turn AS INTEGER) AS position, CAST(good ->> '$.index' AS INTEGER) AS i, good ->> '$.summary' AS summary, good ->> '$.layerHint' AS hint
  FROM parsed WHERE status <> 'failed'),
requested AS (SELECT conv_id, unnest([1, 3, 4]) AS i FROM (SELECT DISTINCT conv_id FROM returned)),
problems AS (
  SELECT conv_id, 'count' AS rule, 'summary batch returned ' || count(*) || ' items, want 3' AS detail FROM returned GROUP BY conv_id HAVING count(*) <> 3
  UNION ALL SELECT conv_id, 'unrequested', 'summaries[' || position || '].index ' || i || ' was not requested' FROM returned WHERE i NOT IN (1, 3, 4)
  UNION ALL SELECT conv_id, 'duplicate', 'summaries[' || position || '].index ' || i || ' is duplicated' FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, i ORDER BY position) AS k FROM returned) WHERE k > 1
  UNION ALL SELECT conv_id, 'blank', 'summaries[' || position || '].summary must not be empty' FROM returned WHERE trim(summary) = ''
  UNION ALL SELECT conv_id, 'layer', 'summaries[' || position || '].layerHint is not in the allowed enum' FROM returned WHERE hint = 'misc'
  UNION ALL SELECT conv_id, 'missing', 'file index ' || i || ' is missing from summary batch' FROM requested WHERE (conv_id, i) NOT IN (SELECT conv_id, i FROM returned))"""


def returned_answers(spark, sf_dir):
    """Usable answers; a conversation is a batch, its turns are the items.

    The turn number serves as position, so no window gathers a long conversation.
    """
    parsed = RS.repair_responses(RS.read_responses(V.responses(spark, sf_dir)), RS.SUMMARY_SCHEMA)
    return parsed.where("status <> 'failed'").select(
        "conv_id", F.col("turn").cast("int").alias("position"), "answer.*"
    )


@query("validate_summaries", f"WITH {ANSWER_SQL} SELECT * FROM problems")
def validate_summaries(spark, sf_dir):
    returned = materialize(returned_answers(spark, sf_dir), "answers")
    requested = returned.select("conv_id").distinct().select(
        "conv_id", F.explode(F.array(F.lit(1), F.lit(3), F.lit(4))).alias("index")
    )
    return VA.validate_summaries(requested, returned, ["conv_id"])


@query("validate_narration", """
SELECT conv_id, turn, 'blank' AS rule, 'intent must not be empty' AS detail FROM conversations WHERE turn % 3 = 0
UNION ALL SELECT conv_id, turn, 'missing', 'reviewNotes must be present' FROM conversations WHERE turn % 2 = 1
UNION ALL SELECT conv_id, turn, 'blank', 'overview must not be empty' FROM conversations WHERE turn % 5 = 0""")
def validate_narration(spark, sf_dir):
    turns = V.table(spark, sf_dir, "conversations")
    blank = F.lit(chr(0xA0) + " \t")
    rows = turns.select(
        "conv_id", "turn", F.lit("T").alias("title"), F.when(F.col("turn") % 3 == 0, blank).otherwise("i").alias("intent"),
        F.col("text").alias("narrative"), F.when(F.col("turn") % 2 == 0, F.array("role")).alias("reviewNotes"),
        F.when(F.col("turn") % 5 == 0, "").otherwise("o").alias("overview"),
    )
    keys = ["conv_id", "turn"]
    return VA.validate_narration(rows, keys).unionByName(VA.validate_synthesis(rows, keys))


@query("stub_failed_batches", f"""WITH {O.FILES}, batches AS (SELECT change_id, file_idx // 6 AS batch_idx, file_idx, path, status, additions, deletions FROM files),
ok AS (SELECT DISTINCT change_id, batch_idx FROM (SELECT change_id, batch_idx, unnest([0, 1, 2]) AS attempt FROM batches)
  WHERE attempt < 2 AND (batch_idx + attempt) % 3 <> 0 AND (length(change_id) + batch_idx * 2 + attempt) % 4 <> 0)
SELECT change_id, file_idx, batch_idx, {STUBS_SQL} AS summary, {O.layer('path')} AS layer_hint FROM batches WHERE (change_id, batch_idx) NOT IN (SELECT change_id, batch_idx FROM ok)""")
def stub_failed_batches(spark, sf_dir):
    """Batches of six files; attempts fail to parse or break a rule by their numbers."""
    files = V.files(spark, sf_dir)
    batches = files.select(*KEY, F.expr("file_idx div 6").cast("int").alias("batch_idx"))
    unit = ["change_id", "batch_idx"]
    tries = batches.select(*unit).distinct().withColumn("attempt", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    tries = tries.withColumn("parsed", (F.col("batch_idx") + F.col("attempt")) % 3 != 0)
    broken = tries.where((F.length("change_id") + F.col("batch_idx") * 2 + F.col("attempt")) % 4 == 0)
    accepted = VA.accepted_attempts(tries, broken, unit)
    stubs = A.file_stub(files.withColumn("reason", F.lit(None).cast("string")))
    return VA.stub_failed_batches(batches, accepted, stubs)


