"""Change-set tables derived from the document, event, page and conversation tables.

A change is one source, so a source with a third of all documents is one change of that size.
Every document is a file with its whole text as lines. Some documents have a second file without
lines, a binary one or an exact rename.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.sources.shared import materialize_once

HUNK_LINES = 40

# Fixed values of the view: directory and file extension by file number modulo 16.
FOLDERS = (
    "db/migrations", "src/app", "api/routes", "ui/components",
    "tests/unit", "settings", "docs", "vendor/lib",
    "infra/network", "web/styles", "web/pages", "jvm/org/acme",
    "jvm/org/acme", "mobile/screens", "assets/img", "",
)
ENDINGS = (
    ".sql", ".go", ".py", ".tsx", ".ts", ".yaml", ".md", ".min.js",
    ".tf", ".css", ".html", ".java", ".kt", ".ios.ts", ".PNG", ".txt",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def copies() -> Column:
    """``plain`` of the files of one document: its text, and for some a file without lines."""
    twice = (F.col("doc_id") % 17 == 0) | (F.col("doc_id") % 11 == 2)
    return F.when(twice, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))


def numbered_texts(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Texts as files with their number in the change; no task holds the texts of one change.

    The numbers come from counts per document, so texts are dealt by document, to ``parts`` partitions
    if given. Both columns may be null or repeat, so they meet as one struct, ``key``, by which the rows
    stay dealt. Rows of a document are put in order first, and the join takes them as they are.
    """
    key = F.struct("change_id", "doc_id").alias("key")
    before = Window.partitionBy("change_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    firsts = docs.groupBy("change_id", "doc_id").agg(F.count("*").alias("n")).select(
        key, "n", F.coalesce(F.sum(F.col("n") * F.size(copies())).over(before), F.lit(0)).alias("first")
    )
    turn = F.row_number().over(Window.partitionBy("key").orderBy("lang")) - 1
    dealt = docs.withColumn("key", key)
    dealt = dealt.repartition(parts, "key") if parts else dealt
    return (
        dealt.withColumn("turn", turn).join(firsts, "key")
        .select(*docs.columns, "key", "first", "n", "turn", F.posexplode(copies()).alias("copy", "plain"))
        .withColumn("file_idx", (F.col("first") + F.col("n") * F.col("copy") + F.col("turn")).cast("int"))
        .drop("first", "n", "turn", "copy")
    )


def documents(spark: SparkSession, sf_dir: str, text: bool = False, measures: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """Documents as files of a change: identity, path and status columns.

    ``plain`` files hold the text; the others are binary or renamed as they are, without lines.
    ``measures`` are further columns, small values of a document. Texts are dealt to ``parts`` partitions, if given.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.col("source").alias("change_id"), *(["text"] if text else []),
        *[value.alias(name) for name, value in (measures or {}).items()],
    )
    if text:
        docs = numbered_texts(docs, parts)
    else:
        order = Window.partitionBy("change_id").orderBy("doc_id", F.desc("plain"))
        docs = docs.select("*", F.explode(copies()).alias("plain")).withColumn("file_idx", F.row_number().over(order) - 1)
    folder = pick(FOLDERS, F.col("file_idx"))
    path = F.concat(
        F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"), F.col("lang"), F.lit("/"))),
        F.when(F.col("plain"), "doc_").otherwise("copy_"), F.col("doc_id").cast("string"), pick(ENDINGS, F.col("file_idx")),
    )
    kind = F.col("doc_id") % 11
    status = (
        F.when(kind == 0, "added").when(kind == 1, "deleted").when(kind == 2, "renamed")
        .otherwise("modified")
    )
    return (
        docs.withColumn("path", path)
        .withColumn("status", status)
        .withColumn("binary", ~F.col("plain") & (F.col("doc_id") % 17 == 0))
        .withColumn(
            "similarity",
            F.when(F.col("status") != "renamed", 0).when(F.col("plain"), 90).otherwise(100),
        )
        .withColumn(
            "old_path",
            F.when(F.col("status") == "renamed", F.concat(F.lit("old/"), F.col("path")))
            .otherwise(F.col("path")),
        )
        .withColumn("new_path", F.col("path"))
        .withColumn("mode_changed", F.col("doc_id") % 23 == 0)
    )


def line_kind(position: Column) -> Column:
    turn = (F.col("doc_id") * 31 + position) % 7
    return (
        F.when(F.col("status") == "added", "a").when(F.col("status") == "deleted", "d")
        .when(turn <= 1, "d").when(turn <= 3, "a").otherwise("c")
    )


def text_lines(text: Column) -> Column:
    return F.split(text, "\n")


FILE_COLUMNS = [
    "change_id", "file_idx", "doc_id", "path", "old_path", "new_path", "status", "binary",
    "similarity", "mode_changed", "additions", "deletions", "hunk_count",
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``files`` table; churn is counted inside each row, without exploding lines."""
    docs = documents(spark, sf_dir, measures={"n_lines": F.size(text_lines(F.col("text")))})
    docs = docs.withColumn("line_count", F.when(F.col("plain"), F.col("n_lines")).otherwise(0))

    def churn(kind: str) -> Column:
        positions = F.when(
            F.col("line_count") > 0, F.sequence(F.lit(0), F.col("line_count") - 1)
        ).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(positions, lambda i: line_kind(i) == kind))

    return (
        docs.withColumn("additions", churn("a"))
        .withColumn("deletions", churn("d"))
        .withColumn("hunk_count", F.ceil(F.col("line_count") / HUNK_LINES).cast("int"))
        .select(*FILE_COLUMNS)
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``lines`` table: one row per document line; ``pos`` counts lines of the file."""
    return keyed_lines(spark, sf_dir).drop("key")


def keyed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines`` with the ``key`` by which they are dealt: steps by key, file or hunk move no line."""
    docs = documents(spark, sf_dir, text=True).where("plain")
    rows = docs.select(
        "key", "change_id", "file_idx", "doc_id", "status",
        F.posexplode(text_lines(F.col("text"))).alias("pos", "text"),
    ).withColumn("t", line_kind(F.col("pos")))
    before = Window.partitionBy("key", "change_id", "file_idx").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        rows.withColumn("n_old", F.sum((F.col("t") != "a").cast("int")).over(before).cast("int"))
        .withColumn("n_new", F.sum((F.col("t") != "d").cast("int")).over(before).cast("int"))
        .select(
            "key", "change_id", "file_idx",
            F.expr(f"pos div {HUNK_LINES}").cast("int").alias("hunk_idx"),
            (F.col("pos") % HUNK_LINES).alias("line_idx"),
            "t",
            F.when(F.col("t") != "a", F.col("n_old")).otherwise(0).alias("old"),
            F.when(F.col("t") != "d", F.col("n_new")).otherwise(0).alias("new"),
            "text", "pos", "doc_id",
        )
    )


def hunks(line_rows: DataFrame) -> DataFrame:
    """The ``hunks`` table of given lines: starts, counts and a header text."""
    return (
        line_rows.groupBy("change_id", "file_idx", "hunk_idx")
        .agg(
            F.coalesce(F.min(F.nullif("old", F.lit(0))), F.lit(0)).alias("old_start"),
            F.count_if(F.col("t") != "a").cast("int").alias("old_count"),
            F.coalesce(F.min(F.nullif("new", F.lit(0))), F.lit(0)).alias("new_start"),
            F.count_if(F.col("t") != "d").cast("int").alias("new_count"),
        )
        .withColumn(
            "header",
            F.when(F.col("hunk_idx") % 2 == 0, F.format_string("block %d", "hunk_idx")).otherwise(""),
        )
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified-diff text per file, rendered from the tables: (change_id, file_idx, section)."""
    line_rows = keyed_lines(spark, sf_dir)
    body = line_rows.groupBy("key", "change_id", "file_idx", "hunk_idx").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "line_idx",
                    F.concat(
                        F.when(F.col("t") == "a", "+").when(F.col("t") == "d", "-").otherwise(" "),
                        "text",
                    ).alias("row"),
                )
            )
        ).alias("rows"),
        F.coalesce(F.min(F.nullif("old", F.lit(0))), F.lit(0)).alias("old_start"),
        F.count_if(F.col("t") != "a").alias("old_count"),
        F.coalesce(F.min(F.nullif("new", F.lit(0))), F.lit(0)).alias("new_start"),
        F.count_if(F.col("t") != "d").alias("new_count"),
    )
    hunk_text = body.select(
        "key", "change_id", "file_idx", "hunk_idx",
        F.concat(
            F.format_string("@@ -%d,%d +%d,%d @@", "old_start", "old_count", "new_start", "new_count"),
            F.when(F.col("hunk_idx") % 2 == 0, F.format_string(" block %d", "hunk_idx")).otherwise(""),
            F.lit("\n"),
            F.array_join(F.col("rows.row"), "\n"),
        ).alias("hunk"),
    )
    per_file = hunk_text.groupBy("key", "change_id", "file_idx").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("hunk_idx", "hunk")))["hunk"], "\n"
        ).alias("hunks")
    ).drop("key")
    head = documents(spark, sf_dir).withColumn(
        "meta",
        F.concat(
            F.lit("diff --git a/"), "old_path", F.lit(" b/"), "new_path",
            F.when(F.col("mode_changed"), "\nold mode 100644\nnew mode 100755").otherwise(""),
            F.when(F.col("status") == "added", "\nnew file mode 100644")
            .when(F.col("status") == "deleted", "\ndeleted file mode 100644")
            .when(
                F.col("status") == "renamed",
                F.concat(
                    F.lit("\nsimilarity index "), F.col("similarity").cast("string"),
                    F.lit("%\nrename from "), "old_path", F.lit("\nrename to "), "new_path",
                ),
            ).otherwise(""),
            F.when(
                F.col("binary"),
                F.concat(F.lit("\nBinary files a/"), "old_path", F.lit(" and b/"), "new_path", F.lit(" differ")),
            ).otherwise(F.concat(F.lit("\n--- a/"), "old_path", F.lit("\n+++ b/"), "new_path")),
        ),
    )
    return head.join(per_file, ["change_id", "file_idx"], "left").select(
        "change_id", "file_idx", "doc_id",
        F.concat_ws("\n", "meta", "hunks").alias("section"),
    )


def patch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered sections as a table, written once per application."""
    return materialize_once(spark, f"patch-text {sf_dir}", lambda: sections(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to six links per file of a change, without self links.

    Most lead to earlier files. Some lead forward, over one file or sixteen, and close cycles.
    """
    docs = documents(spark, sf_dir).select("change_id", "file_idx")
    sized = docs.withColumn("n", F.count("*").over(Window.partitionBy("change_id")).cast("int"))
    i, n = F.col("file_idx"), F.col("n")
    targets = F.array_compact(
        F.array(
            F.when(i % 3 == 0, (i * 7 + 3) % (i + 1)), F.when(i % 4 == 0, (i * 5 + 1) % (i + 1)), F.when(i >= 16, i - 16),
            F.when(i % 10 == 3, (i + 1) % n), F.when(i % 20 == 4, i - 1), F.when(i % 50 == 25, (i + 16) % n),
        )
    )
    return (
        sized.select("change_id", i.alias("importer"), F.explode(F.array_distinct(targets)).alias("imported"))
        .where("importer <> imported")
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(change_id, path, attribute, value) rows for labelled documents."""
    marks = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    docs = documents(spark, sf_dir).select("change_id", "doc_id", "path")
    value = (
        F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), "set")
        .when(F.col("toxic") == 1, "TRUE").when(F.col("quality") == 1, "unspecified")
        .otherwise("unset")
    )
    return docs.join(marks, "doc_id").select(
        "change_id", "path", F.lit("linguist-generated").alias("attribute"), value.alias("value")
    )


def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten blamed lines per file, from ten consecutive events."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    docs = documents(spark, sf_dir).select("doc_id", "change_id", "path")
    stamp = F.unix_timestamp("ts")
    return (
        events.withColumn("doc_id", F.expr("event_id div 10"))
        .join(docs, "doc_id")
        .select(
            "change_id", "path",
            (F.col("event_id") % 10 * 4 + 1).cast("int").alias("line"),
            F.sha1(F.col("event_id").cast("string")).alias("commit"),
            F.format_string("user %d", "user_id").alias("author"),
            (stamp - 60).alias("author_ts"), F.lit("+0000").alias("author_tz"),
            F.when(F.col("event_id") % 7 == 0, F.lit(0)).otherwise(stamp).cast("long").alias("committer_ts"),
            F.when(F.col("event_id") % 3 == 0, "+0530").when(F.col("event_id") % 3 == 1, "-0800")
            .otherwise("+0000").alias("committer_tz"),
            F.col("event_id").alias("seq"),
        )
    )


def json_escape(text: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers: one per turn, in five shapes by conversation number."""
    turns = table(spark, sf_dir, "conversations")
    shape = F.col("conv_id") % 5
    summary = F.when(shape == 3, F.col("text")).otherwise(json_escape(F.col("text")))
    hints = F.array(*[F.lit(h) for h in ("schema", "backend", "api", "ui", "tests", "docs", "misc")])
    hint = F.element_at(hints, ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))
    body = F.concat(
        F.lit('{"index": '), (F.col("turn") % 6).cast("string"),
        F.lit(', "summary": "'), summary, F.lit('", "layerHint": "'), hint,
        F.lit('", "keySymbols": ["sym_'), F.col("conv_id").cast("string"), F.lit('"]}'),
    )
    raw = (
        F.when(shape == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(shape == 2, F.concat(F.lit("Sure. "), body, F.lit(" That is all.")))
        .when(shape == 4, F.substring(body, F.lit(1), F.length(body) - 12))
        .otherwise(body)
    )
    return turns.select("conv_id", "turn", raw.alias("raw"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort claims on files: (change_id, cohort_idx, pos, file_idx), some wrong on purpose."""
    docs = documents(spark, sf_dir).select("change_id", "file_idx", "lang")
    i = F.col("file_idx")
    cohort = (
        F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1)
        .when(F.col("lang") == "fr", 2).otherwise(3)
    )
    named = F.array_compact(
        F.array(
            F.when(i % 10 != 3, F.struct(cohort.alias("cohort_idx"), i.alias("pos"), i.alias("file_idx"))),
            F.when(i % 9 == 4, F.struct(((cohort + 1) % 5).alias("cohort_idx"), (i + 5000).alias("pos"), i.alias("file_idx"))),
            F.when(i % 13 == 5, F.struct(cohort.alias("cohort_idx"), (i + 9000).alias("pos"), (i + 100000).alias("file_idx"))),
        )
    )
    return docs.select("change_id", F.inline(named))


def claim_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort records behind the claims: five per change, one with an unknown layer."""
    changes = documents(spark, sf_dir).select("change_id").distinct()
    layers = F.array(*[F.lit(v) for v in ("schema", "backend", "mystery", "tests", "docs")])
    idx = F.col("cohort_idx")
    return changes.select(
        "change_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("cohort_idx")
    ).select(
        "change_id", "cohort_idx",
        F.format_string("Cohort %d", idx).alias("title"),
        F.element_at(layers, idx + 1).alias("layer"),
        F.array(F.greatest(idx - 1, F.lit(0)), F.greatest(idx - 2, F.lit(0)), F.lit(4), F.lit(0)).alias("depends_on"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary assets by side; the path comes from the page address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.octet_length("html").alias("bytes"))
    endings = (".png", ".jpg", ".bin", ".svg", ".gif")
    path = F.concat(
        F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), F.lit("/p"),
        F.col("page_id").cast("string"), pick(endings, F.col("page_id")),
    )
    status = (
        F.when(F.col("page_id") % 6 == 0, "deleted").when(F.col("page_id") % 6 == 1, "added")
        .otherwise("modified")
    )
    return pages.select(
        F.format_string("pages-%d", F.expr("page_id div 25")).alias("change_id"),
        (F.col("page_id") % 25).cast("int").alias("file_idx"),
        path.alias("path"), status.alias("status"),
        F.when((F.col("page_id") % 6 != 1) & (F.col("page_id") % 10 != 9), F.expr("bytes * (page_id % 7 + 1) div 2"))
        .cast("long").alias("old_size"),
        F.when((F.col("page_id") % 6 != 0) & (F.col("page_id") % 10 != 8), F.col("bytes") * 1)
        .cast("long").alias("new_size"),
    )


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results keyed by content, with a version and an age."""
    return table(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("key"),
        F.concat(F.lit("entries/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"),
        (F.col("doc_id") * 7919 % 1009).alias("mtime"),
        F.when(F.col("doc_id") % 5 == 0, 5).otherwise(6).alias("schema_version"),
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 2 == 0).alias("staged"),
        F.col("doc_id").alias("doc_id"),
    )
