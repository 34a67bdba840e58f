"""Window computations over lines (per hunk) and over files (per change or cohort)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.paths import classify_layer, path_parts
from changeloom.functions.text import changed_spans
from changeloom.operators.ranking import rank_rows
from changeloom.settings import DEFAULTS, LAYERS, Settings

HUNK = ["change_id", "file_idx", "hunk_idx"]


def added_runs(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Added lines with ``run_idx``: a run ends at any other line, a gap or the hunk's end."""
    order = Window.partitionBy(*HUNK).orderBy("line_idx")
    before_t, before_new = F.lag("t").over(order), F.lag("new").over(order)
    starts = (before_t.isNull() | (before_t != "a")
              | ((before_new > 0) & (F.col("new") > 0) & (F.col("new") != before_new + 1)))
    marked = lines.withColumn("starts", (starts & (F.col("t") == "a")).cast("int"))
    run = F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return (
        marked.withColumn("run_idx", run.cast("int")).where("t = 'a'")
        .select(*HUNK, *(keep or []), "run_idx", "line_idx", "text")
    )


def islands(lines: DataFrame) -> DataFrame:
    """Add ``island`` (run of one line kind), ``at`` (place in it, from 1) and its ``size``."""
    order = Window.partitionBy(*HUNK).orderBy("line_idx")
    turn = F.coalesce((F.lag("t").over(order) != F.col("t")).cast("int"), F.lit(0))
    inside = Window.partitionBy(*HUNK, "island")
    return (
        lines.withColumn("turn", turn)
        .withColumn("island", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("at", F.row_number().over(inside.orderBy("line_idx")))
        .withColumn("size", F.count("*").over(inside))
        .drop("turn")
    )


def pair_changed_lines(lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Changed spans of deleted lines and the added lines that directly follow them.

    Pairs meet in one aggregation on (hunk, run pair, offset), which keeps the hunk's
    partitioning; there is no self-join.
    """
    placed = islands(lines).where("t <> 'c'").withColumn(
        "pair", F.col("island") - (F.col("t") == "a").cast("int")
    )

    def side(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("t") == kind, F.col(column)))

    pairs = placed.groupBy(*HUNK, "pair", "at").agg(
        side("d", "line_idx").alias("old_line"), side("a", "line_idx").alias("new_line"),
        side("d", "text").alias("old_text"), side("a", "text").alias("new_text"),
    ).where("old_line is not null and new_line is not null")
    marked = changed_spans(
        pairs, "old_text", "new_text", settings.long_line_threshold, settings.word_diff_min_similarity
    )
    return marked.select(*HUNK, "old_line", "new_line", "start", "old_end", "new_end")


def fold_context(lines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Hidden context lines; the first of a fold carries the number of hidden lines."""
    keep = settings.fold_context
    hidden = (
        (F.col("t") == "c") & (F.col("size") > settings.fold_threshold)
        & (F.col("at") > keep) & (F.col("at") <= F.col("size") - keep)
    )
    count = F.when(F.col("at") == keep + 1, F.col("size") - 2 * keep).otherwise(0)
    return islands(lines).where(hidden).select(*HUNK, "line_idx", count.cast("int").alias("fold_count"))


def step_nav(cohort_files: DataFrame) -> DataFrame:
    """Position, total and neighbours of each file inside its cohort; -1 for none."""
    inside = Window.partitionBy("change_id", "cohort_idx")
    order = inside.orderBy("pos")
    return cohort_files.select(
        "change_id", "cohort_idx", "file_idx",
        F.row_number().over(order).alias("position"),
        F.count("*").over(inside).cast("int").alias("total"),
        F.coalesce(F.lag("file_idx").over(order), F.lit(-1)).alias("prev_file"),
        F.coalesce(F.lead("file_idx").over(order), F.lit(-1)).alias("next_file"),
    )


def known_layer(layer: Column) -> Column:
    return F.when(layer.isin(*LAYERS), layer).otherwise("other")


def first_assignment(claims: DataFrame, sizes: DataFrame, bounded: bool = True) -> DataFrame:
    """Each file stays in the first cohort that names it; cohorts are renumbered densely.

    ``claims`` is (change_id, cohort_idx, pos, file_idx), ``sizes`` (change_id, n) the number
    of files. The first claim is a partial aggregation, so repeated claims combine before
    the shuffle.
    """
    valid = claims.join(sizes, "change_id").where("file_idx >= 0 AND file_idx < n")
    first = valid.groupBy("change_id", "file_idx").agg(
        F.min(F.struct("cohort_idx", "pos")).alias("claim")
    ).select("change_id", "file_idx", F.col("claim.cohort_idx").alias("old_idx"), F.col("claim.pos").alias("claim_pos"))
    kept = first.select("change_id", "old_idx").distinct()
    renumbered = rank_rows(kept, ["change_id"], ["old_idx"], "cohort_idx", bounded=bounded)
    placed = first.join(renumbered, ["change_id", "old_idx"])
    key = ["change_id", "cohort_idx"]
    return rank_rows(placed, key, ["claim_pos", "file_idx"], "pos", bounded=bounded).drop("claim_pos")


def prefix_budget(
    items: DataFrame, group: list[str], order: list[str], size: str, budget: int | str,
    bounded: bool = True,
) -> DataFrame:
    """The ordered prefix of each group whose sizes fit the budget; stops at the first miss."""
    limit = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    summed = rank_rows(items, group, order, "rank", {"spent": size}, bounded)
    return summed.where(F.col("spent") <= limit)


def flat_chunks(
    items: DataFrame, group: list[str], order: list[str], max_files: int, bounded: bool = True
) -> DataFrame:
    """Split groups into chunks of ``max_files``; adds chunk, total (from 1) and pos."""
    chunks = F.ceil(F.count("*") / max_files).cast("int")
    ranked = rank_rows(items, group, order, "rank", bounded=bounded)
    if bounded:
        sized = ranked.withColumn(
            "total", F.ceil(F.count("*").over(Window.partitionBy(*group)) / max_files).cast("int")
        )
    else:
        sized = ranked.join(items.groupBy(*group).agg(chunks.alias("total")), group)
    return sized.select(
        *items.columns,
        (F.floor(F.col("rank") / max_files) + 1).cast("int").alias("chunk"), "total",
        (F.col("rank") % max_files).alias("pos"),
    )


def plan_cohorts(
    files: DataFrame, max_files: int = DEFAULTS.staging_max_files, bounded: bool = True
) -> DataFrame:
    """Group files by layer and directory into cohorts of at most ``max_files``.

    Every directory of a path is counted once per layer; a file goes to its shallowest
    directory which is small enough. Where even its own directory is too large, the files
    directly in it are split into chunks. Returns (change_id, cohort_idx, pos, file_idx,
    title, layer, directory).
    """
    parts = path_parts(F.col("path"))
    folders = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array(F.lit(".")))
    base = files.select(
        "change_id", "file_idx", "path", classify_layer(F.col("path")).alias("layer"),
        folders.alias("folders"),
    )
    levels = base.select(
        "change_id", "file_idx", "layer",
        F.explode(F.sequence(F.lit(1), F.size("folders"))).alias("level"), "folders",
    ).withColumn("directory", F.array_join(F.slice("folders", F.lit(1), F.col("level")), "/")).drop("folders")
    key = ["change_id", "layer", "directory"]
    if bounded:
        # All windows of this plan keep the partitioning by change: one shuffle in all.
        counted = levels.withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    else:
        counted = levels.join(levels.groupBy(*key).agg(F.count("*").alias("n")), key)
    fitting = counted.where(F.col("n") <= max_files).groupBy("change_id", "file_idx").agg(
        F.min(F.struct("level", "directory"))["directory"].alias("fit")
    )
    placed = base.join(fitting, ["change_id", "file_idx"], "left")
    own = F.array_join("folders", "/")
    placed = placed.select(
        "change_id", "file_idx", "path", "layer",
        F.coalesce("fit", own).alias("directory"), F.col("fit").isNull().alias("oversized"),
    )
    # Groups that fit have one chunk by construction, so one chunking step serves both.
    group = ["change_id", "layer", "directory", "oversized"]
    chunked = flat_chunks(placed, group, ["path", "file_idx"], max_files, bounded)
    label = F.when(F.col("directory") == ".", "Root").otherwise(F.col("directory"))
    title = F.concat(
        label, F.lit(" "), "layer", F.lit(" changes"),
        F.when(F.col("total") > 1, F.format_string(" (%d/%d)", "chunk", "total")).otherwise(""),
    )
    chunk_key = [*group, "chunk"]
    order = ["first_path", "layer", "directory", "chunk"]
    if bounded:
        led = chunked.withColumn("first_path", F.min("path").over(Window.partitionBy(*chunk_key)))
        number = F.dense_rank().over(Window.partitionBy("change_id").orderBy(*order)) - 1
        numbered = led.withColumn("cohort_idx", number)
    else:
        firsts = chunked.groupBy(*chunk_key).agg(F.min("path").alias("first_path"))
        ranked = rank_rows(firsts, ["change_id"], order, "cohort_idx", bounded=False)
        numbered = chunked.join(ranked.drop("first_path"), chunk_key)
    return numbered.select(
        "change_id", "cohort_idx", "pos", "file_idx", title.alias("title"), "layer", "directory"
    )
