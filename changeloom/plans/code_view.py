"""Source lines derived from the files and links of each change, in Spark and in SQL.

Every link of the ``edges`` view becomes an import in the importer's language, written in
one of four styles, and every file defines a symbol. The line texts are SQL expressions
without engine-specific parts, shared by both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.functions.paths import classify_language
from changeloom.plans import oracle_views as O
from changeloom.plans import views as V
from changeloom.sources.shared import materialize_dealt

FILE = ["change_id", "file_idx"]
PART_BYTES = 32 << 20

# Columns: l language, i and j file numbers, m style, tt target module, ts its last two
# parts, tp target path, td target directory, up way to the root, dj target document.
IMPORT_LINE = """CASE
  WHEN l = 'javascript' AND m = 0 THEN 'import {' || chr(10) || '  a, // from "no"' || chr(10) || '} from "' || tt || '";'
  WHEN l = 'javascript' AND m = 1 THEN 'import "' || ts || '";'
  WHEN l = 'javascript' AND m = 2 THEN 'const b = require("@app/' || ts || '");'
  WHEN l = 'javascript' THEN 'export * from "' || up || tp || '";'
  WHEN l = 'go' AND m % 2 = 0 THEN 'import "' || td || '"'
  WHEN l = 'go' THEN 'import x "example.com/mod/' || td || '"'
  WHEN l = 'python' AND m = 0 THEN 'from ' || replace(tt, '/', '.') || ' import a'
  WHEN l = 'python' AND m = 1 THEN 'import os, ' || replace(ts, '/', '.') || ' as z'
  WHEN l = 'python' AND m = 2 THEN 'from .' || split_part(tt, '/', -1) || ' import a'
  WHEN l = 'python' THEN 'from ...' || replace(tt, '/', '.') || ' import a'
  WHEN l = 'java' AND m = 3 THEN 'import ' || replace(td, '/', '.') || '.*;'
  WHEN l = 'java' THEN 'import org.acme.' || replace(ts, '/', '.') || ';'
  WHEN l = 'kotlin' AND m = 3 THEN 'import ' || replace(td, '/', '.') || '.*'
  WHEN l = 'kotlin' THEN 'import org.acme.' || replace(ts, '/', '.') || ' as k'
  WHEN l = 'html' AND m % 2 = 0 THEN '<script src="' || up || tp || '"></script>'
  WHEN l = 'html' THEN '<!-- <img src="no.png"> --><a href="z"><img alt="q>" src="' || up || tp || '">'
  WHEN l = 'css' AND m % 2 = 0 THEN '@import "' || up || tp || '";'
  WHEN l = 'css' THEN '.a { background: url(' || up || tp || ') } /* url(no.png) */'
  WHEN l = 'terraform' AND m = 1 THEN 'module "m' || i || '_' || j || '" {' || chr(10) || '  z = { source = "./no" }' || chr(10) || '  source = "./"' || chr(10) || '}'
  WHEN l = 'terraform' AND m = 3 THEN 'z = aws_thing.r_' || dj || '.id # var.no'
  WHEN l = 'terraform' THEN 'x = var.v_' || dj
  ELSE 'see ' || tp END"""

DEFINE_LINE = """CASE
  WHEN l = 'javascript' THEN 'export const sym_' || doc_id || ' = 1;'
  WHEN l = 'go' THEN 'func Sym_' || doc_id || '() int {'
  WHEN l = 'python' THEN 'def sym_' || doc_id || '():'
  WHEN l = 'java' THEN 'public class sym_' || doc_id || ' {'
  WHEN l = 'kotlin' THEN 'fun sym_' || doc_id || '() = 1'
  WHEN l = 'terraform' THEN '# see <<EOT' || chr(10) || 'variable "v_' || doc_id || '" {}' || chr(10) || '/* two' || chr(10) || 'lines */' || chr(10) || 'resource "aws_thing" "r_' || doc_id || '" {}'
    || chr(10) || 'locals {' || chr(10) || '  l_' || doc_id || ' = 1' || chr(10) || '  b_' || doc_id || ' = { c = "x" }' || chr(10) || '}'
    || chr(10) || 'n = "${f("p-${var.v_' || doc_id || '}")} $${var.no}"' || chr(10) || 'h = [<<EOT' || chr(10) || 'aws_thing.no' || chr(10) || '${local.l_' || doc_id || '}' || chr(10) || 'EOT' || chr(10) || ']'
  ELSE 'text of ' || path END"""

SHARED_LINE = """CASE
  WHEN l = 'javascript' THEN 'export function shared_helper() {}'
  WHEN l = 'python' THEN 'def shared_helper():'
  WHEN l = 'go' THEN 'func Shared_helper() {}'
  ELSE 'shared text' END"""

USE_LINE = "'use(sym_' || dj || ', Sym_' || dj || ')'"


def targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files with language and module columns, and links with both ends' columns."""
    files = V.documents(spark, sf_dir).select(
        "change_id", "file_idx", "doc_id", "path", classify_language(F.col("path")).alias("l"),
        F.regexp_replace("path", r"(\.ios)?\.[^./]*$", "").alias("tt"),
        F.regexp_extract("path", r"^(.*)/", 1).alias("dir"),
    )
    source = files.select(
        "change_id", F.col("file_idx").alias("i"), "l",
        F.expr("repeat('../', length(path) - length(replace(path, '/', '')))").alias("up"),
    )
    target = files.select(
        "change_id", F.col("file_idx").alias("j"), "tt", F.col("path").alias("tp"),
        F.col("dir").alias("td"), F.col("doc_id").alias("dj"), F.col("l").alias("tl"),
        F.coalesce(F.nullif(F.regexp_extract("tt", r"([^/]+/[^/]+)$", 1), F.lit("")), "tt").alias("ts"),
    )
    links = V.edges(spark, sf_dir).select("change_id", F.col("importer").alias("i"), F.col("imported").alias("j"))
    joined = links.join(source, ["change_id", "i"]).join(target, ["change_id", "j"]).withColumn(
        "m", F.expr("(i div 3 + j div 4) % 4").cast("int")
    )
    return files, joined


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines`` rows: definitions, imports, a context line, uses, a deleted line and the file's whole text.

    Written once per application, as several queries read them, in buckets of files: readers join and
    order the lines of a file, and shuffle no text for it.
    """
    count = lambda: text_parts(spark, sf_dir)
    return materialize_dealt(spark, f"source-lines {sf_dir}", FILE, count, lambda parts: build_lines(spark, sf_dir, parts))


def text_parts(spark: SparkSession, sf_dir: str) -> int:
    """Number of parts for the texts: a part grows neither with the input nor with few shuffle partitions."""
    size = V.table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def build_lines(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    files, links = targets(spark, sf_dir)
    i = F.col("i").alias("file_idx")

    def block(rows: DataFrame, index, order, kind: str, text: str) -> DataFrame:
        return rows.select("change_id", index, order.cast("int").alias("ord"), F.lit(kind).alias("t"), F.expr(text).alias("block"))

    own = F.col("file_idx")
    pieces = [
        block(files, own, F.lit(0), "a", DEFINE_LINE),
        block(files.where("file_idx % 7 = 0"), own, F.lit(1), "a", SHARED_LINE),
        block(links, i, F.col("j") + 2, "a", IMPORT_LINE),
        block(files, own, F.lit(1 << 27), "c", "'context'"),
        block(links.where("m % 2 = 0"), i, F.col("j") + (1 << 28), "a", USE_LINE),
        block(files, own, F.lit(1 << 29), "d", "'removed'"),
        block(V.documents(spark, sf_dir, text=True, parts=parts).where("plain"), own, F.lit(1 << 30), "a", "text"),
    ]
    rows = pieces[0]
    for piece in pieces[1:]:
        rows = rows.unionByName(piece)
    # Blocks are dealt and numbered by file before they are split, so no line is moved or sorted.
    dealt = rows.withColumn("size", F.coalesce(F.array_size(F.split("block", "\n")), F.lit(0))).repartition(parts, *FILE)
    before = Window.partitionBy(*FILE).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("t").isin(*kinds), F.col("size")).otherwise(0)).over(before), F.lit(0))

    numbered = dealt.select(
        *FILE, "t", "block", earlier("a", "c", "d").alias("first"), earlier("c", "d").alias("olds"), earlier("a", "c").alias("news")
    )
    exploded = numbered.select(*FILE, "t", "first", "olds", "news", F.posexplode(F.split("block", "\n")).alias("k", "text"))
    return exploded.select(
        *FILE, F.lit(0).alias("hunk_idx"), (F.col("first") + F.col("k")).cast("int").alias("line_idx"), "t",
        F.when(F.col("t") == "a", 0).otherwise(F.col("olds") + F.col("k") + 1).cast("int").alias("old"),
        F.when(F.col("t") == "d", 0).otherwise(F.col("news") + F.col("k") + 1).cast("int").alias("new"), "text",
    )


# SQL side: ``cf`` files with language and module, ``links`` with both ends.
LINKS = O.DOCS + O.EDGES + f""",
cf AS (
  SELECT change_id, file_idx, doc_id, path, {O.language('path')} AS l,
         regexp_replace(path, '(\\.ios)?\\.[^./]*$', '') AS tt, regexp_extract(path, '^(.*)/', 1) AS dir
  FROM docs),
links AS (
  SELECT e.change_id, e.importer AS i, e.imported AS j, (e.importer // 3 + e.imported // 4) % 4 AS m, s.l, s.doc_id AS di,
         s.path AS sp, s.dir AS sd, repeat('../', length(s.path) - length(replace(s.path, '/', ''))) AS up,
         t.tt, t.path AS tp, t.dir AS td, t.doc_id AS dj, t.l AS tl,
         coalesce(nullif(regexp_extract(t.tt, '([^/]+/[^/]+)$', 1), ''), t.tt) AS ts
  FROM edges e JOIN cf s ON s.change_id = e.change_id AND s.file_idx = e.importer
               JOIN cf t ON t.change_id = e.change_id AND t.file_idx = e.imported)"""

SOURCE_LINES = LINKS + f""",
blocks AS (
  SELECT change_id, file_idx, 0 AS ord, 'a' AS t, {DEFINE_LINE} AS block FROM cf
  UNION ALL SELECT change_id, file_idx, 1, 'a', {SHARED_LINE} FROM cf WHERE file_idx % 7 = 0
  UNION ALL SELECT change_id, i, j + 2, 'a', {IMPORT_LINE} FROM links
  UNION ALL SELECT change_id, file_idx, {1 << 27}, 'c', 'context' FROM cf
  UNION ALL SELECT change_id, i, j + {1 << 28}, 'a', {USE_LINE} FROM links WHERE m % 2 = 0
  UNION ALL SELECT change_id, file_idx, {1 << 29}, 'd', 'removed' FROM cf
  UNION ALL SELECT change_id, file_idx, {1 << 30}, 'a', text FROM docs WHERE plain),
code0 AS (
  SELECT change_id, file_idx, ord, t, unnest(string_split(block, chr(10))) AS text,
         unnest(range(len(string_split(block, chr(10))))) AS k FROM blocks),
code AS (
  SELECT change_id, file_idx, CAST(row_number() OVER (PARTITION BY change_id, file_idx ORDER BY ord, k) - 1 AS INTEGER) AS line_idx, t, text
  FROM code0)"""

# What the imports must resolve to. Document numbers are unique, so a module name matches
# one file; the rules below say when that file may answer.
RESOLVED = LINKS + """,
whole AS (
  SELECT *, tp LIKE '%.ios.ts' AS is_ios, tp LIKE '%.min.js' AS is_min, td = '' AS at_root FROM links WHERE i <> j),
resolved AS (
  SELECT change_id, i AS importer, j AS imported, CASE WHEN is_ios THEN 'platform' ELSE 'exact' END AS via
  FROM whole WHERE l = 'javascript' AND m = 0 AND tl = 'javascript'
  UNION ALL SELECT change_id, i, j, 'exact' FROM whole WHERE l = 'javascript' AND m = 3
  UNION ALL SELECT change_id, i, j, 'suffix' FROM whole WHERE l = 'javascript' AND m = 1 AND tl = 'javascript' AND NOT is_ios
  UNION ALL SELECT change_id, i, j, 'alias' FROM whole WHERE l = 'javascript' AND m = 2 AND tl = 'javascript' AND NOT is_ios AND NOT is_min
  UNION ALL SELECT change_id, i, j, 'exact' FROM whole WHERE l = 'python' AND tl = 'python' AND (m = 0 OR (m = 2 AND sd = td))
  UNION ALL SELECT change_id, i, j, 'suffix' FROM whole WHERE l = 'python' AND tl = 'python' AND m = 1
  UNION ALL SELECT change_id, i, j, 'suffix' FROM whole WHERE l IN ('java', 'kotlin') AND tl IN ('java', 'kotlin') AND m <> 3
  UNION ALL SELECT change_id, i, j, 'exact' FROM whole WHERE l IN ('html', 'css')),
packaged AS (
  SELECT DISTINCT w.change_id, w.i AS importer, f.file_idx AS imported
  FROM whole w JOIN cf f ON f.change_id = w.change_id AND f.dir = w.td AND f.file_idx <> w.i
  WHERE (w.l = 'go' AND f.l = 'go') OR (w.l IN ('java', 'kotlin') AND w.m = 3 AND f.l IN ('java', 'kotlin'))),
owners AS (
  SELECT change_id, doc_id, l = 'go' AS capital, min(file_idx) AS file_idx FROM cf
  WHERE l IN ('javascript', 'python', 'java', 'kotlin', 'go') GROUP BY ALL HAVING count(*) = 1),
symbolic AS (
  SELECT w.change_id, w.i AS importer, o.file_idx AS imported FROM whole w JOIN owners o ON o.change_id = w.change_id AND o.doc_id = w.dj
  WHERE m % 2 = 0 AND o.file_idx <> w.i),
terraformed AS (
  SELECT change_id, i AS importer, j AS imported FROM whole WHERE l = 'terraform' AND tl = 'terraform' AND sd = td AND m <> 1
  UNION SELECT w.change_id, w.i, f.file_idx FROM whole w JOIN cf f ON f.change_id = w.change_id AND f.dir = w.sd AND f.l = 'terraform' AND f.file_idx <> w.i
  WHERE w.l = 'terraform' AND w.m = 1),
built AS (
  SELECT change_id, importer, imported FROM resolved UNION SELECT * FROM packaged
  UNION SELECT * FROM symbolic UNION SELECT * FROM terraformed)"""
