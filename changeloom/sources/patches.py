"""Unified diffs: scan, and parse into file, hunk and line tables.

A patch is read as one row per file section, so one huge patch still splits over many
tasks. Everything after that works inside one section or one hunk, never inside a patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.sources.shared import materialize

# The forms of a unified diff.
SECTION_MARK = "diff --git "
NUMBER = r"([+-]?\d+)"
HUNK_HEADER = (
    rf"@@ -{NUMBER}(?:,{NUMBER})?[ \t]+\+?{NUMBER}(?:,{NUMBER})?(?:[ \t][^\n]*?)?? @@([^\n]*)"
)
FIELD = r'("(?:[^"\\]|\\.)*+"|[^\s"]\S*+)'
# Single-letter escapes of quoted paths and their byte values, and the other escapes.
ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D", "\\": "5C", '"': "22"}
CODE_POINT = r"u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|U000(?!0[dD][89a-fA-F])[0-9a-fA-F]{5}|U0010[0-9a-fA-F]{4}"
ESCAPE = rf'\\(?:[abtnvfr\\"]|[0-3][0-7]{{2}}|x[0-9a-fA-F]{{2}}|{CODE_POINT})'


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """(change_id, file_idx, section): the file sections of every patch under ``path``.

    The change is the patch file. Section numbers come from the read blocks: a block knows
    how many sections the blocks before it hold, so no task sees a whole patch. Text in
    front of the first section (a mail header) is dropped. The rows are written once, so the
    patches are scanned once and numbers stay the same when a task runs again.
    """
    rows = materialize(
        spark.read.option("lineSep", "\n" + SECTION_MARK).text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("change_id"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .withColumn("seq", F.monotonically_increasing_id()),
        "patch-rows",
    )
    spans = rows.groupBy("change_id", "block").agg(
        F.min("seq").alias("first_seq"),
        F.count("*").alias("n"),
        F.min_by(F.col("value").startswith(SECTION_MARK), "seq").alias("marked"),
    )
    preamble = F.when((F.col("block") == 0) & ~F.col("marked"), 1).otherwise(0)
    before = Window.partitionBy("change_id").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = spans.withColumn("real", F.col("n") - preamble).select(
        "change_id", "block", "first_seq", preamble.alias("preamble"),
        F.coalesce(F.sum("real").over(before), F.lit(0)).alias("offset"),
    )
    first = (F.col("block") == 0) & (F.col("seq") == F.col("first_seq"))
    return (
        rows.join(starts, ["change_id", "block"])
        .where(~(first & (F.col("preamble") == 1)))
        .select(
            "change_id",
            (F.col("offset") + F.col("seq") - F.col("first_seq") - F.col("preamble"))
            .cast("int").alias("file_idx"),
            F.when(first, F.col("value")).otherwise(F.concat(F.lit(SECTION_MARK), "value"))
            .alias("section"),
        )
    )


def unquote(path: Column) -> Column:
    """Undo C-style quoting of a path; unquoted paths stay, quoted ones with bad escapes are null."""
    body = F.regexp_replace(path, r'^"|"$', "")
    valid = path.rlike(rf'^"(?:[^"\\]|{ESCAPE})*+"$')
    tokens = F.regexp_extract_all(body, F.lit(rf"({ESCAPE}|[^\\])"), F.lit(1))

    def to_hex(token: Column) -> Column:
        plain = F.hex(F.encode(token, "UTF-8"))
        letter = F.substring(token, 2, 1)
        escaped = F.hex(F.encode(letter, "UTF-8"))
        for char, code in ESCAPES.items():
            escaped = F.when(letter == char, code).otherwise(escaped)
        octal = F.lpad(F.conv(F.substring(token, 2, 3), 8, 16), 2, "0")
        digits = F.substring(token, F.lit(3), F.length(token))
        point = F.hex(F.encode(F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"), "UTF-8"))
        return (
            F.when(~token.startswith("\\"), plain).when(token.rlike(r"^\\[0-7]{3}$"), octal)
            .when(letter == "x", digits).when(F.lower(letter) == "u", point).otherwise(escaped)
        )

    decoded = F.unhex(F.array_join(F.transform(tokens, to_hex), "")).cast("string")
    return F.when(~path.startswith('"'), path).when(valid, decoded)


def unix_lines(section: Column) -> Column:
    return F.when(section.contains("\r"), F.regexp_replace(section, r"\r(?=\n|\z)", "")).otherwise(section)


def header_paths(header: Column) -> tuple[Column, Column]:
    """Old and new path of a section header, null when it cannot be split."""
    twin = F.nullif(F.regexp_extract(header, r"^a/(.*) b/\1$", 1), F.lit(""))
    plain = r"^(a/.*?) (b/.*)$"
    fields = rf"^\s*{FIELD}\s*{FIELD}\s*$"
    has_plain = header.rlike(plain)

    def side(group: int, mark: str) -> Column:
        field = unquote(F.nullif(F.regexp_extract(header, fields, group), F.lit("")))
        whole = F.when(has_plain, F.regexp_extract(header, plain, group)).otherwise(field)
        return F.coalesce(twin, F.regexp_replace(whole, f"^{mark}/", ""))

    return side(1, "a"), side(2, "b")


def last_match(section: Column, pattern: str) -> Column:
    """First group of the last line that matches, null when none does."""
    found = F.regexp_extract_all(section, F.lit(f"(?md){pattern}"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def parse_files(sections: DataFrame) -> DataFrame:
    """Sections → ``files`` rows without churn; ``header_ok`` is false for broken headers.

    All metadata comes from the section's own text, so this step needs no shuffle.
    """
    text = sections.withColumn("section", unix_lines(F.col("section")))
    section = F.col("section")
    header = F.regexp_extract(section, r"^diff --git ([^\n]*)", 1)
    old_header, new_header = header_paths(header)
    mode = last_match(section, "^(new file mode|deleted file mode|rename from) ")
    path_rule = last_match(section, "^(deleted file mode|rename to) ")

    def renamed(pattern: str, otherwise: Column) -> Column:
        written = last_match(section, pattern)
        return F.coalesce(unquote(written), written, otherwise)

    old_path = renamed(r"^rename from (.*)$", old_header)
    new_path = renamed(r"^rename to (.*)$", new_header)
    return text.select(
        *[c for c in sections.columns if c != "section"],
        F.when(path_rule == "deleted file mode", old_path).when(path_rule == "rename to", new_path)
        .otherwise(new_header).alias("path"),
        old_path.alias("old_path"),
        new_path.alias("new_path"),
        F.when(mode == "new file mode", "added").when(mode == "deleted file mode", "deleted")
        .when(mode == "rename from", "renamed").otherwise("modified").alias("status"),
        section.rlike(r"(?md)^(?:Binary files |GIT binary patch$)").alias("binary"),
        F.coalesce(last_match(section, r"^similarity index ([+-]?\d+)%?$").try_cast("int"), F.lit(0))
        .alias("similarity"),
        section.rlike(r"(?md)^(?:old|new) mode ").alias("mode_changed"),
        (old_header.isNotNull() & new_header.isNotNull()).alias("header_ok"),
    )


def hunk_pieces(sections: DataFrame) -> DataFrame:
    """One row per hunk with its numbers and its raw body."""
    starts = F.split(unix_lines(F.col("section")), rf"(?md)^(?={HUNK_HEADER})")
    pieces = sections.select("change_id", "file_idx", F.posexplode(starts).alias("piece", "text"))

    def part(group: int) -> Column:
        return F.regexp_extract("text", "^" + HUNK_HEADER, group)

    def count(group: int) -> Column:
        return F.coalesce(F.nullif(part(group), F.lit("")).try_cast("bigint"), F.lit(1))

    return pieces.where(F.col("text").rlike("^" + HUNK_HEADER)).select(
        "change_id", "file_idx",
        # Text before the first hunk is piece 0, unless the section starts with a hunk.
        (F.col("piece") - 1).alias("hunk_idx"),
        F.trim(part(5)).alias("header"),
        part(1).try_cast("bigint").alias("old_start"), count(2).alias("old_count"),
        part(3).try_cast("bigint").alias("new_start"), count(4).alias("new_count"),
        F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)$", 1).alias("body"),
    )


def parse_hunks(sections: DataFrame) -> DataFrame:
    return hunk_pieces(sections).drop("body")


def parse_lines(sections: DataFrame) -> DataFrame:
    """Content lines inside the declared counts, numbered on both sides.

    A hunk closes before the first line at which both sides are complete; later lines are
    trailers. The window runs per hunk.
    """
    rows = hunk_pieces(sections).select(
        "change_id", "file_idx", "hunk_idx", "old_start", "old_count", "new_start", "new_count",
        F.posexplode(F.split("body", "\n")).alias("row", "raw"),
    )
    mark = F.substring("raw", 1, 1)
    kind = F.when(mark == "+", "a").when(mark == "-", "d").when(mark == " ", "c")
    rows = rows.withColumn("t", kind).where("t is not null")
    order = Window.partitionBy("change_id", "file_idx", "hunk_idx").orderBy("row")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn(
        "n_old", F.coalesce(F.sum((F.col("t") != "a").cast("int")).over(earlier), F.lit(0))
    ).withColumn("n_new", F.coalesce(F.sum((F.col("t") != "d").cast("int")).over(earlier), F.lit(0)))
    complete = (F.col("n_old") == F.col("old_count")) & (F.col("n_new") == F.col("new_count"))
    return (
        seen.withColumn("closed", F.max(complete).over(upto))
        .withColumn("line_idx", F.row_number().over(order) - 1)
        .where("not closed")
        .select(
            "change_id", "file_idx", "hunk_idx", "line_idx", "t",
            F.when(F.col("t") == "a", 0).otherwise(F.col("old_start") + F.col("n_old")).cast("bigint").alias("old"),
            F.when(F.col("t") == "d", 0).otherwise(F.col("new_start") + F.col("n_new")).cast("bigint").alias("new"),
            F.substring(F.col("raw"), F.lit(2), F.length("raw")).alias("text"),
        )
    )


def parse_errors(sections: DataFrame) -> DataFrame:
    """``errors`` rows: broken headers. Only their change is unusable, not the job."""
    return header_errors(parse_files(sections.select("change_id", "section", header_text())))


def header_text() -> Column:
    """A section's header without its mark, as column ``header``."""
    return F.regexp_extract("section", r"^diff --git ([^\n]*?)\r?(?=\n|\z)", 1).alias("header")


def header_errors(files: DataFrame) -> DataFrame:
    """``errors`` rows of parsed files that kept their ``header``."""
    return files.where("not header_ok").select(
        "change_id", F.lit("header").alias("rule"), F.concat(F.lit("parse diff header: "), "header").alias("detail")
    )


def empty_changes(changes: DataFrame, files: DataFrame) -> DataFrame:
    """``errors`` rows for changes without any file section."""
    return changes.join(files, "change_id", "left_anti").select(
        "change_id", F.lit("empty").alias("rule"), F.lit("change has no file sections").alias("detail")
    )
