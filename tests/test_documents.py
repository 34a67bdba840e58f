"""Documents in parts: no line holds more than a file or a cohort, and together they are the whole documents."""

import json

from pyspark.sql import functions as F

from changeloom.operators import assemble as S


def tables(spark):
    keys = spark.range(12).select(
        F.when(F.col("id") % 4 == 3, "b").otherwise("a").alias("change_id"), F.col("id").cast("int").alias("file_idx")
    )
    path = F.format_string("p%d", 20 - F.col("file_idx"))
    files = keys.select(
        "*", path.alias("path"), path.alias("old_path"), path.alias("new_path"), F.lit("modified").alias("status"),
        (F.col("file_idx") % 5 == 0).alias("binary"), F.lit(0).alias("similarity"), F.lit(False).alias("mode_changed"),
        F.lit(1).alias("additions"), F.lit(0).alias("deletions"),
    )
    hunks = keys.where("file_idx % 5 <> 0").select("*", F.lit(0).alias("hunk_idx"), F.lit("").alias("header"))
    lines = hunks.select(
        "change_id", "file_idx", "hunk_idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("line_idx"), F.lit("a").alias("t"),
        F.lit(0).alias("old"), F.lit(1).alias("new"), F.format_string('text "%d"', "file_idx").alias("text"),
    )
    placed = keys.select("*", F.expr("file_idx div 4").cast("int").alias("cohort_idx"), (F.col("file_idx") % 4).alias("pos"))
    told = placed.select("change_id", "cohort_idx").distinct().select(
        "*", F.lit("t").alias("title"), F.lit("l").alias("layer"), F.lit("i").alias("intent"), F.lit(None).cast("string").alias("narrative"),
        F.array(F.lit("n")).alias("review_notes"), (F.col("cohort_idx") == 1).alias("stubbed"),
    )
    summaries = keys.where("file_idx <> 2").select(
        "*", F.lit("s").alias("summary"), F.array(F.lit("x")).alias("key_symbols"), (F.col("file_idx") % 3 == 0).alias("stubbed")
    )
    deps = spark.createDataFrame([("a", 2, 0, 1)], "change_id string, cohort_idx int, rank int, dep_idx int")
    changes = spark.createDataFrame(
        [(c, "T", "D", "R", None, "N") for c in ("a", "b", "gone", None)],
        "change_id string, title string, description string, range string, url string, name string",
    )
    return files, hunks, lines, placed, told, summaries, deps, changes


def documents_of(spark, whole):
    files, hunks, lines, placed, told, summaries, deps, changes = tables(spark)
    analyses = S.assemble_analysis(placed, told, summaries, deps, whole)
    finished = S.finished_analysis(
        analyses, changes.select("change_id", "title", F.col("description").alias("overview")), files, summaries,
        files.where("binary"), told.where("stubbed"), whole,
    )
    staged = changes.select("change_id", F.lit(True).alias("staged"))
    return S.documents(changes, S.nested_files(files, hunks, lines), finished, staged, "p", "m", whole)


def test_parts_hold_one_file_or_cohort_and_make_whole_documents(spark, tmp_path):
    parts = documents_of(spark, whole=False)
    S.doc_sink(parts, str(tmp_path / "parts"))
    S.doc_sink(documents_of(spark, whole=True), str(tmp_path / "whole"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "parts")).collect()]
    assert len(lines) == 2 + 12 + 12 + 6  # changes, files, marks, cohorts
    assert sum("file" in x for x in lines) == 12 and {x["change_id"] for x in lines} == {"a", "b"}

    whole = spark.read.schema(documents_of(spark, whole=True).schema).json(str(tmp_path / "whole"))
    again = S.whole_documents(spark.read.schema(parts.schema).json(str(tmp_path / "parts")))
    expected, found = ({r.change_id: r for r in x.select(*whole.columns).collect()} for x in (whole, again))
    assert expected == found and expected["a"].analysis.stubbedFiles == [9, 6, 0]
