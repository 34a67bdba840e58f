"""Data-quality rules: every violation is one row of ``errors(change_id, rule, detail)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.functions.text import is_blank
from changeloom.settings import LAYERS


def errors(rows: DataFrame, rule: str, detail: Column, extra: list[str] | None = None) -> DataFrame:
    keys = ["change_id"] if extra is None else extra
    return rows.select(*keys, F.lit(rule).alias("rule"), detail.alias("detail"))


def all_of(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def index_message(suffix: str, column: str) -> Column:
    return F.format_string("cohorts[%d]." + suffix, "cohort_idx", column)


def validate_membership(
    changes: DataFrame, cohorts: DataFrame, claims: DataFrame, deps: DataFrame
) -> DataFrame:
    """Rules on which file is in which cohort.

    ``changes`` is (change_id, n) with the number of files, ``cohorts`` (change_id,
    cohort_idx, layer, summary_count), ``claims`` (change_id, cohort_idx, pos, file_idx) and
    ``deps`` (change_id, cohort_idx, dep_idx). Files are counted per index with a partial
    aggregation and compared with the full index range of the change.
    """
    prefix = F.format_string("cohorts[%d]", "cohort_idx")
    none = errors(
        changes.join(cohorts.select("change_id").distinct(), "change_id", "left_anti"), "no_cohorts",
        F.lit("cohorts must contain at least one item"),
    )
    layer = errors(
        cohorts.where(~F.coalesce(F.col("layer").isin(*LAYERS), F.lit(False))), "layer",
        F.concat(prefix, F.lit(".layer is not in the allowed enum")),
    )
    counts = claims.groupBy("change_id", "cohort_idx").agg(F.count("*").alias("claimed"))
    sized = cohorts.join(counts, ["change_id", "cohort_idx"], "left").fillna(0, ["claimed"])
    empty = errors(sized.where("claimed = 0"), "empty", F.concat(prefix, F.lit(".files must not be empty")))
    parallel = errors(
        sized.where("summary_count <> claimed"), "parallel",
        F.concat(prefix, F.lit(".fileSummaries must be parallel to files")),
    )
    numbered = claims.join(changes, "change_id")
    outside = F.col("file_idx").isNull() | (F.col("file_idx") < 0) | (F.col("file_idx") >= F.col("n"))
    bad_index = errors(
        numbered.where(outside), "range", index_message("files contains out-of-range index %d", "file_idx")
    )
    late = errors(
        deps.where("dep_idx < 0 OR dep_idx >= cohort_idx"), "dependency",
        index_message("dependsOn contains %d, which is not an earlier cohort", "dep_idx"),
    )
    held = numbered.where(~outside).groupBy("change_id", "file_idx").agg(F.count("*").alias("times"))
    twice = errors(
        held.where("times > 1"), "duplicate",
        F.format_string("file index %d is assigned to multiple cohorts", "file_idx"),
    )
    every = changes.join(cohorts.select("change_id").distinct(), "change_id", "left_semi").where("n > 0").select(
        "change_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("file_idx")
    )
    missing = errors(
        every.join(held, ["change_id", "file_idx"], "left_anti"), "unassigned",
        F.format_string("file index %d is not assigned to a cohort", "file_idx"),
    )
    return all_of(none, layer, empty, parallel, bad_index, late, twice, missing)


def index_list_errors(rows: DataFrame, sizes: DataFrame, label: str) -> DataFrame:
    """Range and duplicate rules of one index list (change_id, idx)."""
    joined = rows.join(sizes, "change_id")
    bad = (F.col("idx") < 0) | (F.col("idx") >= F.col("n"))
    outside = errors(
        joined.where(bad), "range", F.format_string(f"{label} contains out-of-range index %d", "idx")
    )
    repeated = (
        joined.where(~bad).groupBy("change_id", "idx").agg(F.count("*").alias("times")).where("times > 1")
        # A value that comes n times is reported n - 1 times.
        .withColumn("again", F.explode(F.sequence(F.lit(2), F.col("times").cast("int"))))
    )
    twice = errors(repeated, "duplicate", F.format_string(f"{label} contains duplicate index %d", "idx"))
    return outside.unionByName(twice)


def validate_complete(
    membership: DataFrame, changes: DataFrame, cohorts: DataFrame, stubbed: DataFrame,
    mechanical: DataFrame, symbols: DataFrame, stubbed_cohorts: DataFrame,
) -> DataFrame:
    """Membership rules and the rules on the index lists of a finished analysis.

    ``stubbed``, ``mechanical`` and ``stubbed_cohorts`` are (change_id, idx); ``symbols`` is
    (change_id, listed, missing): the number of symbol lists, and of null ones.
    """
    cohort_sizes = cohorts.groupBy("change_id").agg(F.count("*").alias("n"))
    valid = stubbed.join(changes, "change_id").where("idx >= 0 AND idx < n").select("change_id", "idx").distinct()
    both = errors(
        mechanical.join(valid, ["change_id", "idx"]), "disjoint",
        F.format_string("file index %d cannot be both stubbed and mechanical", "idx"),
    )
    counted = changes.join(symbols, "change_id", "left").fillna(0, ["listed", "missing"])
    unequal = errors(
        counted.where("listed <> n"), "symbols", F.lit("fileKeySymbols must be parallel to files")
    )
    absent = errors(
        counted.where("listed = n AND missing > 0"), "symbols",
        F.format_string("%d lists of fileKeySymbols must be present", "missing"),
    )
    return all_of(
        membership,
        index_list_errors(stubbed, changes, "stubbedFiles"),
        index_list_errors(mechanical, changes, "mechanicalFiles"),
        both, unequal, absent,
        index_list_errors(stubbed_cohorts, cohort_sizes, "stubbedCohorts"),
    )


def required_texts(rows: DataFrame, names: list[str], keys: list[str], prefix: Column | None = None) -> DataFrame:
    lead = F.lit("") if prefix is None else prefix
    return all_of(*[
        errors(rows.where(is_blank(F.col(name))), "blank", F.concat(lead, F.lit(f"{name} must not be empty")), keys)
        for name in names
    ])


def required_lists(rows: DataFrame, names: list[str], keys: list[str], prefix: Column | None = None) -> DataFrame:
    lead = F.lit("") if prefix is None else prefix
    return all_of(*[
        errors(rows.where(F.col(name).isNull()), "missing", F.concat(lead, F.lit(f"{name} must be present")), keys)
        for name in names
    ])


def validate_content(analyses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Blank texts and missing lists of one-pass answers (keys, title, overview, cohorts)."""
    keys = keys or ["change_id"]
    cohorts = analyses.select(*keys, F.posexplode("cohorts").alias("cohort_idx", "c")).select(*keys, "cohort_idx", "c.*")
    lead = F.format_string("cohorts[%d].", "cohort_idx")
    none = errors(
        analyses.where(F.col("cohorts").isNull() | (F.size("cohorts") == 0)), "no_cohorts",
        F.lit("cohorts must contain at least one item"), keys,
    )
    return all_of(
        required_texts(analyses, ["title", "overview"], keys),
        none,
        required_texts(cohorts, ["title", "layer", "intent", "narrative"], keys, lead),
        required_lists(cohorts, ["files", "fileSummaries", "reviewNotes", "dependsOn"], keys, lead),
    )


def validate_claims(analyses: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Rules on the file lists of one-pass answers before repeated and missing files are mended.

    ``sizes`` is (change_id, n), the number of files.
    """
    cohorts = analyses.select(*keys, F.posexplode("cohorts").alias("cohort_idx", "c")).select(*keys, "cohort_idx", "c.files", "c.fileSummaries")
    length = lambda name: F.size(F.coalesce(name, F.array()))
    parallel = errors(
        cohorts.where(length("files") != length("fileSummaries")), "parallel",
        F.format_string("cohorts[%d].fileSummaries must be parallel to files", "cohort_idx"), keys,
    )
    named = cohorts.select(*keys, "cohort_idx", F.explode("files").alias("file_idx")).join(sizes, "change_id")
    outside = F.col("file_idx").isNull() | (F.col("file_idx") < 0) | (F.col("file_idx") >= F.col("n"))
    wrong = errors(named.where(outside), "range", index_message("files contains out-of-range index %d", "file_idx"), keys)
    return parallel.unionByName(wrong)


def validate_finished(analyses: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every rule on finished analyses (change_id, analysis), their lists and their texts."""
    own = sizes.join(analyses, "change_id", "left_semi")
    whole = analyses.select("change_id", "analysis.*")
    rows = whole.select("change_id", F.posexplode("cohorts").alias("cohort_idx", "c"))
    cohorts = rows.select("change_id", "cohort_idx", "c.layer", F.size("c.fileSummaries").alias("summary_count"))
    claims = rows.select("change_id", "cohort_idx", F.posexplode("c.files").alias("pos", "file_idx"))
    deps = rows.select("change_id", "cohort_idx", F.explode("c.dependsOn").alias("dep_idx"))
    part = lambda name: whole.select("change_id", F.explode(name).alias("idx"))
    symbols = whole.where("fileKeySymbols IS NOT NULL").select(
        "change_id", F.size("fileKeySymbols").alias("listed"),
        F.size(F.filter("fileKeySymbols", lambda x: x.isNull())).alias("missing"),
    )
    complete = validate_complete(
        validate_membership(own, cohorts, claims, deps), own, cohorts, part("stubbedFiles"), part("mechanicalFiles"),
        symbols, part("stubbedCohorts"),
    )
    names = ["stubbedFiles", "mechanicalFiles", "fileKeySymbols", "stubbedCohorts"]
    return all_of(complete, required_lists(whole, names, ["change_id"]), validate_content(whole))


def validate_narration(narrations: DataFrame, keys: list[str]) -> DataFrame:
    return required_texts(narrations, ["title", "intent", "narrative"], keys).unionByName(
        required_lists(narrations, ["reviewNotes"], keys)
    )


def validate_synthesis(synthesis: DataFrame, keys: list[str]) -> DataFrame:
    return required_texts(synthesis, ["title", "overview"], keys)


def validate_summaries(requested: DataFrame, returned: DataFrame, unit: list[str]) -> DataFrame:
    """Rules on the answers to a batch of files.

    ``requested`` is ``unit`` + index, ``returned`` is ``unit`` + (position, index, summary,
    layerHint, keySymbols). Both sides are counted per index before they meet, so an index
    that is returned many times does not multiply.
    """
    wanted = requested.groupBy(*unit).agg(F.count("*").alias("want"))
    got = returned.groupBy(*unit).agg(F.count("*").alias("items"))
    size = wanted.join(got, unit, "left").fillna(0, ["items"]).where("items <> want")
    number = F.format_string("summary batch returned %d items, want %d", "items", "want")
    asked = requested.select(*unit, "index").distinct()
    seen = returned.groupBy(*unit, "index").agg(F.count("*").alias("times"), F.min("position").alias("first"))
    missing = errors(
        asked.join(seen, [*unit, "index"], "left_anti"), "missing",
        F.format_string("file index %d is missing from summary batch", "index"), unit,
    )
    lead = F.format_string("summaries[%d]", "position")
    alien = errors(
        returned.join(asked, [*unit, "index"], "left_anti"), "unrequested",
        F.concat(lead, F.format_string(".index %d was not requested", "index")), unit,
    )
    again = errors(
        returned.join(seen.where("times > 1"), [*unit, "index"]).where("position > first"), "duplicate",
        F.concat(lead, F.format_string(".index %d is duplicated", "index")), unit,
    )
    blank = errors(
        returned.where(is_blank(F.col("summary"))), "blank", F.concat(lead, F.lit(".summary must not be empty")), unit
    )
    layer = errors(
        returned.where(~F.coalesce(F.col("layerHint").isin(*LAYERS), F.lit(False))), "layer",
        F.concat(lead, F.lit(".layerHint is not in the allowed enum")), unit,
    )
    lists = errors(
        returned.where(F.col("keySymbols").isNull()), "missing_list",
        F.concat(lead, F.lit(".keySymbols must be present")), unit,
    )
    return all_of(errors(size, "count", number, unit), alien, again, blank, layer, lists, missing)


def accepted_attempts(attempts: DataFrame, violations: DataFrame, unit: list[str]) -> DataFrame:
    """The first of two attempts of each unit that parsed and broke no rule.

    ``attempts`` is ``unit`` + (attempt, parsed); ``violations`` names broken attempts.
    """
    broken = violations.select(*unit, "attempt").distinct()
    good = attempts.where("parsed AND attempt < 2").join(broken, [*unit, "attempt"], "left_anti")
    return good.groupBy(*unit).agg(F.min("attempt").alias("attempt"))


def stub_failed_batches(batches: DataFrame, accepted: DataFrame, stubs: DataFrame) -> DataFrame:
    """Stub summaries for every file of a batch without an accepted attempt."""
    failed = batches.join(accepted, ["change_id", "batch_idx"], "left_anti")
    return failed.select("change_id", "batch_idx", "file_idx").join(
        stubs.select("change_id", "file_idx", "summary", "layer_hint"), ["change_id", "file_idx"]
    )
