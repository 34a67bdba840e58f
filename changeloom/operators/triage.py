"""Triage of files: mechanical ones with a reason, and flags which never gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.paths import base_name, to_slashes
from changeloom.functions.text import strip_space
from changeloom.operators.ranking import rank_rows
from changeloom.sources.shared import materialize
from changeloom.sources.tables import generated_paths

# Names behind the flags.
LOCKFILES = (
    "cargo.lock", "composer.lock", "gemfile.lock", "go.sum", "package-lock.json",
    "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock",
)
VENDOR_FOLDERS = ("node_modules", "third_party", "vendor", "vendors")


# Letters whose count is compared before any text moves.
LETTERS = "etaoinshr0123456789(){};=."
PIECE = 1024


def whitespace_only(lines: DataFrame) -> DataFrame:
    """(change_id, file_idx) of files whose deleted and added text differ in white space only.

    Lengths and counts of letters of both sides are sums, which combine before the shuffle; only files
    where they agree go on. There, both sides are cut at the same places of their joined text,
    found by running lengths, and compared piece by piece, so no task holds a file.
    """
    key = ["change_id", "file_idx"]
    changed = lines.where("t <> 'c'").select(*key, "t", "hunk_idx", "line_idx", strip_space(F.col("text")).alias("solid"))
    sign = F.when(F.col("t") == "a", 1).otherwise(-1)
    sums = [sign * F.length("solid"), sign * F.length(F.translate("solid", LETTERS, ""))]
    level = changed.groupBy(*key).agg(*[F.sum(x).alias(f"s{k}") for k, x in enumerate(sums)])
    likely = materialize(level.where(" AND ".join(f"s{k} = 0" for k in range(len(sums)))).select(*key), "level-files")
    rows = materialize(changed.where("solid <> ''").join(likely, key, "left_semi").withColumn("size", F.length("solid").cast("long")), "level-lines")
    placed = rank_rows(rows, [*key, "t"], ["hunk_idx", "line_idx"], "n", {"upto": "size"}, bounded=False)
    start, first, last = F.col("upto") - F.col("size"), F.floor((F.col("upto") - F.col("size")) / PIECE), F.floor((F.col("upto") - 1) / PIECE)
    cut = placed.withColumn("start", start).select(*key, "t", "start", "upto", "solid", F.explode(F.sequence(first, last)).alias("piece"))
    begin, end = F.greatest(F.col("piece") * PIECE, "start"), F.least((F.col("piece") + 1) * PIECE, "upto")
    part = F.substring("solid", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int"))
    pieces = cut.select(*key, "t", "piece", begin.alias("at"), part.alias("part"))
    side = lambda t: F.array_join(F.array_sort(F.collect_list(F.when(F.col("t") == t, F.struct("at", "part"))))["part"], "")
    differ = pieces.groupBy(*key, "piece").agg(side("d").alias("gone"), side("a").alias("come")).where("gone <> come")
    return likely.join(differ, key, "left_anti")


def path_flags(path: Column) -> Column:
    """Flags from the path alone, in their fixed order; one vendor flag per folder."""
    text = F.lower(to_slashes(path))
    base = base_name(text)

    def one(condition: Column, label: str) -> Column:
        return F.array_compact(F.array(F.when(condition, label)))

    vendored = F.transform(
        F.filter(F.split(text, "/"), lambda part: part.isin(*VENDOR_FOLDERS)),
        lambda _: F.lit("vendored path"),
    )
    return F.concat(
        one(base.isin(*LOCKFILES), "lockfile"),
        vendored,
        one(text.endswith(".pb.go"), "generated-looking filename"),
        one(base.contains(".min."), "minified-looking filename"),
    )


def heuristic_flags(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``flags``: path flags, then the white space flag."""
    blank = whitespace_only(lines).withColumn("blank", F.lit(True))
    extra = F.when(F.col("blank"), F.array(F.lit("whitespace-only changes"))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        files.join(blank, ["change_id", "file_idx"], "left")
        .withColumn("flags", F.concat(path_flags(F.col("path")), extra))
        .drop("blank")
    )


def triage(files: DataFrame, attributes: DataFrame, include_mechanical: bool = False) -> DataFrame:
    """Add ``reason``: why a file is mechanical, null for files worth a review.

    ``files`` needs additions, deletions and hunk_count.
    """
    generated = generated_paths(attributes).withColumn("generated", F.lit(True))
    exact = (
        (F.col("status") == "renamed") & (F.col("similarity") == 100) & ~F.col("mode_changed")
        & (F.col("additions") == 0) & (F.col("deletions") == 0) & (F.col("hunk_count") == 0)
    )
    reason = (
        F.when(exact, "exact rename").when(F.col("generated"), "generated")
        .when(F.col("binary"), "binary")
    )
    if include_mechanical:
        reason = F.lit(None).cast("string")
    return (
        files.join(generated, ["change_id", "path"], "left").withColumn("reason", reason).drop("generated")
    )


def sort_files(files: DataFrame) -> DataFrame:
    """By path, then number, within each change; range-partitioned, so no task sorts it all."""
    return files.orderBy("change_id", "path", "file_idx")


