"""Aggregations over files, lines, cohorts and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.paths import classify_layer
from changeloom.functions.text import byte_prefix, file_header, json_string, line_prefix
from changeloom.operators.ranking import ordered_list, ordered_text, rank_rows
from changeloom.settings import DEFAULTS, SCHEMA_VERSION, Settings

FILE = ["change_id", "file_idx"]

__all__ = ["ordered_list", "ordered_text"]


def file_churn(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*FILE).agg(
        F.count_if(F.col("t") == "a").cast("int").alias("additions"),
        F.count_if(F.col("t") == "d").cast("int").alias("deletions"),
    )


def change_totals(files: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Per change: files, churn, cohorts and mechanical files (``files`` carries ``reason``)."""
    per_change = files.groupBy("change_id").agg(
        F.count("*").alias("files"),
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.count("reason").alias("mechanical"),
    )
    numbers = cohorts.groupBy("change_id").agg(F.countDistinct("cohort_idx").alias("cohorts"))
    return per_change.join(numbers, "change_id", "left").fillna(0, ["cohorts"])


def headers(files: DataFrame) -> DataFrame:
    text = file_header(*[F.col(c) for c in ("file_idx", "path", "status", "additions", "deletions")])
    return files.withColumn("header", text)


def diff_bytes(lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """Bytes of the full diff text per file, without building it."""
    body = lines.groupBy(*FILE).agg(F.sum(F.octet_length("text") + 2).alias("line_bytes"))
    heads = hunks.groupBy(*FILE).agg(F.sum(F.octet_length("header") + 4).alias("head_bytes"))
    return heads.join(body, FILE, "left").select(
        *FILE, (F.col("head_bytes") + F.coalesce("line_bytes", F.lit(0))).alias("diff_bytes")
    )


# The head and a file's row of a digest, texts that stand in for answers, an error.
DIGEST_HEAD = (
    "COHORT: %s\nLAYER: %s\nDIRECTORY: %s\nFILES: %d\nREVIEW_WORTHY: %d\nMECHANICAL: %d\n"
    "FLAGGED: %d\nADDITIONS: %d\nDELETIONS: %d\nSAMPLED_SUMMARIES:\n"
)
DIGEST_ROW = "- FILE %d PATH=%s (+%d/-%d) FLAGS=%s KEY_SYMBOLS=%s SUMMARY=%s\n"
COHORT_STUB = "%d files, +%d/-%d; no model narration was available."
FILE_STUB = "Change in %s (%s, +%d/-%d); no model summary was available."
FILE_SKIPPED = "%s: %s; model analysis was deliberately skipped."
SMALL_BUDGET = "analysis budget %d is too small (minimum %d)"


# The text shown for a binary file.
BINARY_TEXT = "(binary file)\n"


def input_bytes(files: DataFrame, lines: DataFrame, hunks: DataFrame) -> DataFrame:
    """Bytes of headers and full diff texts per change."""
    sized = headers(files).join(diff_bytes(lines, hunks), FILE, "left")
    body = F.when(F.col("binary"), len(BINARY_TEXT)).otherwise(F.coalesce("diff_bytes", F.lit(0)))
    return sized.groupBy("change_id").agg(
        F.sum(F.octet_length("header") + body).alias("input_bytes"),
        F.count("*").alias("files"),
        F.max(F.octet_length("header")).alias("max_header"),
    )


def staging_decision(
    totals: DataFrame, cohorts: DataFrame, budget: int, overhead: int, settings: Settings = DEFAULTS
) -> DataFrame:
    """Staged or one pass, with an error where the budget cannot hold the fixed parts.

    ``totals`` comes from ``input_bytes``, ``cohorts`` from ``plan_cohorts``; ``overhead``
    is the size of the text around the content.
    """
    frames = cohorts.select("change_id", "cohort_idx", "layer").distinct().groupBy("change_id").agg(
        F.sum(
            F.octet_length(F.format_string("COHORT[%d] l=%s t=xxxx r=xxxx\n", "cohort_idx", "layer"))
        ).alias("frame_bytes")
    )
    staged = (F.col("input_bytes") > budget) | (F.col("files") > settings.staging_max_files)
    minimum = overhead + F.greatest("max_header", "frame_bytes")
    short = staged & (minimum > budget)
    return totals.join(frames, "change_id").select(
        "change_id", "input_bytes", staged.alias("staged"), minimum.alias("minimum_budget"),
        F.when(short, F.format_string(SMALL_BUDGET, F.lit(budget), minimum))
        .alias("error"),
    )


def unique_definitions(definitions: DataFrame) -> DataFrame:
    """Symbols which exactly one file of the change defines."""
    per_symbol = definitions.groupBy("change_id", "symbol").agg(
        F.min("file_idx").alias("file_idx"), F.max("file_idx").alias("last_idx")
    )
    return per_symbol.where("file_idx = last_idx").drop("last_idx")


def cohort_weights(cohort_edges: DataFrame) -> DataFrame:
    """Number of file edges per (dependent, dependency) pair of cohorts, from distinct edges."""
    return cohort_edges.groupBy("change_id", "dependent", "dependency").agg(
        F.count("*").alias("weight")
    )


def offset_time(stamp: Column, zone: Column) -> Column:
    """Unix seconds as RFC 3339 text in a ±HHMM zone, independent of the session zone."""
    valid = zone.rlike(r"^.\d{4}$")
    minutes = F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")
    offset = F.when(valid, F.when(zone.startswith("-"), -minutes).otherwise(minutes)).otherwise(0)
    local = stamp + offset * 60
    day = F.date_from_unix_date(F.floor(local / 86400).cast("int")).cast("string")
    second = F.pmod(local, F.lit(86400))
    clock = F.format_string(
        "%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60
    )
    away = F.abs(offset)
    suffix = F.when(offset == 0, "Z").otherwise(
        F.concat(
            F.when(offset < 0, "-").otherwise("+"),
            F.format_string("%02d:%02d", F.floor(away / 60), away % 60),
        )
    )
    return F.concat(day, F.lit("T"), clock, suffix)


def latest_author(records: DataFrame, group: list[str]) -> DataFrame:
    """Author and date of the newest record: committer time, else author time; ties to the later."""
    fallback = F.col("committer_ts") == 0
    stamp = F.when(fallback, F.col("author_ts")).otherwise(F.col("committer_ts"))
    zone = F.when(fallback, F.col("author_tz")).otherwise(F.col("committer_tz"))
    known = records.withColumn("stamp", stamp).withColumn("zone", zone).where("author <> '' AND stamp > 0")
    best = known.groupBy(*group).agg(
        F.max(F.struct("stamp", "seq", "author", "zone")).alias("best")
    )
    return best.select(
        *group, F.col("best.author").alias("author"),
        offset_time(F.col("best.stamp"), F.col("best.zone")).alias("date"),
    )


BLAME_BUCKET = 256


def blame_hunks(files: DataFrame, lines: DataFrame, blame: DataFrame, side: str = "new") -> DataFrame:
    """Latest author per hunk, from the blamed lines inside the hunk's line span.

    An interval join: hunks are spread over buckets of line numbers and blamed lines fall
    into one bucket each, so a long file is many small equi-join keys.
    """
    spans = lines.where(F.col(side) > 0).groupBy(*FILE, "hunk_idx").agg(
        F.min(side).alias("first"), F.max(side).alias("last")
    )
    eligible = files.where("NOT binary AND status <> 'deleted'").select(*FILE, "path")
    bucket = lambda c: F.floor(F.col(c) / BLAME_BUCKET)
    hunks = spans.join(eligible, FILE).withColumn(
        "bucket", F.explode(F.sequence(bucket("first"), bucket("last")))
    )
    placed = blame.withColumn("bucket", bucket("line"))
    hits = hunks.join(placed, ["change_id", "path", "bucket"]).where("line BETWEEN first AND last")
    return latest_author(hits, [*FILE, "hunk_idx"])


def cohort_counts(cohort_files: DataFrame, triaged: DataFrame) -> DataFrame:
    """Counts per cohort; ``triaged`` carries reason and flags."""
    joined = cohort_files.join(triaged.drop("path", "layer"), FILE)
    worthy = F.col("reason").isNull()
    return joined.groupBy("change_id", "cohort_idx").agg(
        F.count("*").alias("files"), F.count_if(worthy).alias("review_worthy"),
        F.count_if(~worthy).alias("mechanical"),
        F.count_if(worthy & (F.size("flags") > 0)).alias("flagged"),
        F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.first("title").alias("title"), F.first("layer").alias("layer"),
        F.first("directory").alias("directory"),
    )


def cohort_digest(
    cohort_files: DataFrame, triaged: DataFrame, summaries: DataFrame, budget: int,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Text per cohort: counts, then as many sampled summaries as fit, most notable first.

    ``summaries`` is (change_id, file_idx, summary, key_symbols).
    """
    cap = min(max(budget, 0), settings.digest_max_chars)
    counts = cohort_counts(cohort_files, triaged).withColumn(
        "head",
        F.format_string(
            DIGEST_HEAD, "title", "layer", "directory", "files", "review_worthy", "mechanical", "flagged",
            "additions", "deletions",
        ),
    ).select("change_id", "cohort_idx", "head")
    row = F.format_string(
        DIGEST_ROW, "file_idx", json_string(F.col("path")), "additions", "deletions",
        F.array_join("flags", ", "),
        json_string(F.array_join(F.coalesce("key_symbols", F.array().cast("array<string>")), ", ")),
        json_string(F.coalesce("summary", F.lit(""))),
    )
    candidates = (
        cohort_files.select("change_id", "cohort_idx", "file_idx")
        .join(triaged.where("reason IS NULL"), FILE)
        .join(summaries, FILE, "left")
        .withColumn("row", row)
        .withColumn("unflagged", (F.size("flags") == 0).cast("int"))
        .withColumn("quiet", -(F.col("additions") + F.col("deletions")))
        .withColumn("bytes", F.octet_length("row"))
        .select("change_id", "cohort_idx", "file_idx", "path", "row", "unflagged", "quiet", "bytes")
    )
    group = ["change_id", "cohort_idx"]
    ranked = rank_rows(candidates, group, ["unflagged", "quiet", "path", "file_idx"], "rank", {"spent": "bytes"})
    fitting = (
        ranked.where(F.col("rank") < settings.digest_max_files)
        .join(counts, group)
        .where(F.octet_length("head") + F.col("spent") <= cap)
    )
    rows = fitting.groupBy(*group).agg(ordered_text(["rank"], "row").alias("rows"))
    text = F.concat("head", F.coalesce("rows", F.lit("")))
    return counts.join(rows, group, "left").select(
        *group, F.when(F.lit(cap) == 0, "").otherwise(byte_prefix(text, F.lit(cap))).alias("digest")
    )


def cohort_stub(cohort_files: DataFrame, files: DataFrame) -> DataFrame:
    """Narration from counts, for cohorts without a usable answer."""
    totals = cohort_files.join(files.select(*FILE, "additions", "deletions"), FILE).groupBy(
        "change_id", "cohort_idx"
    ).agg(
        F.first("title").alias("title"), F.count("*").alias("n"),
        F.sum("additions").alias("a"), F.sum("deletions").alias("d"),
    )
    text = F.format_string(COHORT_STUB, "n", "a", "d")
    return totals.select("change_id", "cohort_idx", "title", text.alias("intent"), text.alias("narrative"))


def file_stub(triaged: DataFrame) -> DataFrame:
    """Fixed summaries: mechanical files with their reason, others as stubs."""
    stub = F.format_string(FILE_STUB, "path", "status", "additions", "deletions")
    skipped = F.format_string(FILE_SKIPPED, "path", "reason")
    return triaged.select(
        *FILE, F.when(F.col("reason").isNull(), stub).otherwise(skipped).alias("summary"),
        classify_layer(F.col("path")).alias("layer_hint"), F.col("reason").isNull().alias("stubbed"),
    )


def content_key(parts: list[Column]) -> Column:
    """Digest over length-prefixed parts, so that no two part lists share a key by chance."""
    pieces = []
    for part in parts:
        text = part.cast("string")
        pieces += [F.octet_length(text).cast("string"), F.lit(":"), text]
    return F.sha2(F.concat(*pieces), 256)


def doc_id(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Short identity of a change: range, version, then path and churn of files in order."""
    nul = F.lit(chr(0))
    entry = F.concat(
        "path", nul, F.col("additions").cast("string"), nul, F.col("deletions").cast("string"), nul
    )
    listing = files.withColumn("entry", entry).groupBy("change_id").agg(
        ordered_text(["file_idx"], "entry").alias("listing")
    )
    head = F.concat("range", nul, F.lit(str(SCHEMA_VERSION)), nul)
    return changes.join(listing, "change_id", "left").select(
        "change_id",
        F.substring(F.sha2(F.concat(head, F.coalesce("listing", F.lit(""))), 256), 1, 16).alias("doc_id"),
    )


def call_plan(batches: DataFrame, cohorts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Model calls per change: batches, cohorts and one synthesis; many need approval."""
    b = batches.groupBy("change_id").agg(F.countDistinct("batch_idx").alias("batches"))
    c = cohorts.groupBy("change_id").agg(F.countDistinct("cohort_idx").alias("cohorts"))
    calls = F.coalesce("batches", F.lit(0)) + F.col("cohorts") + 1
    return c.join(b, "change_id", "left").select(
        "change_id", calls.alias("calls"), (calls > settings.guard_call_threshold).alias("needs_approval")
    )


def diff_text(lines: DataFrame, hunks: DataFrame, files: DataFrame, cap: int | None = None) -> DataFrame:
    """(change_id, file_idx, diff): hunk headers and prefixed lines of each file.

    Without ``cap`` a file's text is one value of its patch again. With a ``cap`` of bytes a longer
    text ends at the first row that passes the cap, which is all that cuts at or below the cap
    read: rows that cannot begin before the cap leave before the shuffle, long lines are
    shortened, and a running sum ends the text, so no group exceeds the cap by more than a row.
    """
    capped = cap is not None and cap >= 0
    text = F.substring("text", 1, cap + 1) if capped else F.col("text")
    heads = hunks.select(*FILE, "hunk_idx", F.lit(-1).alias("line_idx"), F.concat(F.lit("@@ "), "header", F.lit("\n")).alias("row"))
    body = lines.select(*FILE, "hunk_idx", "line_idx", F.concat(line_prefix(F.col("t")), text, F.lit("\n")).alias("row"))
    if capped:
        # A header has four bytes or more, a line two.
        heads = heads.where(F.col("hunk_idx") * 4 <= cap)
        body = body.where(F.col("hunk_idx") * 4 + 4 + F.col("line_idx") * 2 <= cap)
    rows = heads.unionByName(body)
    if capped:
        before = Window.partitionBy(*FILE).orderBy("hunk_idx", "line_idx").rowsBetween(Window.unboundedPreceding, -1)
        begins = F.coalesce(F.sum(F.octet_length("row")).over(before), F.lit(0))
        rows = rows.withColumn("begins", begins).where(F.col("begins") <= cap).drop("begins")
    texts = rows.groupBy(*FILE).agg(ordered_text(["hunk_idx", "line_idx"], "row").alias("text"))
    return files.join(texts, FILE, "left").select(
        *FILE, F.when(F.col("binary"), BINARY_TEXT).otherwise(F.coalesce("text", F.lit(""))).alias("diff")
    )


def hunk_label(hunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Display label per hunk: its header, or the range of its line numbers."""
    number = F.nullif(F.when(F.col("new") == 0, F.col("old")).otherwise(F.col("new")), F.lit(0))
    numbered = lines.withColumn("number", number).where("number IS NOT NULL")
    ends = numbered.groupBy(*FILE, "hunk_idx").agg(
        F.min_by("number", "line_idx").alias("first"), F.max_by("number", "line_idx").alias("last")
    )
    label = (
        F.when(F.col("header") != "", F.col("header")).when(F.col("first").isNull(), "")
        .when(F.col("first") == F.col("last"), F.format_string("line %d", "first"))
        .otherwise(F.format_string("lines %d–%d", "first", "last"))
    )
    return hunks.join(ends, [*FILE, "hunk_idx"], "left").select(*FILE, "hunk_idx", label.alias("label"))


def collapse_flag(threshold: int = DEFAULTS.collapse_threshold) -> Column:
    return F.col("additions") + F.col("deletions") > threshold


def key_symbol_cap(symbols: Column, cap: int = DEFAULTS.key_symbol_cap) -> Column:
    return F.slice(symbols, 1, cap)
