"""Steps that must not grow with one change or with the corpus: where rows sit and how they travel."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from changeloom.functions import imports as I
from changeloom.operators import graph as G
from changeloom.operators import windows as W
from changeloom.plans import code_view as C
from changeloom.plans import views as V


def table(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_texts_of_one_change_lie_in_many_partitions(spark, tmp_path):
    folder = table(spark, tmp_path, [(k, f"text {k}\nmore", "en", "one") for k in range(60)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        places = V.lines(spark, folder).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert places > 1


def test_files_are_numbered_alike_with_and_without_texts(spark, tmp_path):
    rows = [(k, f"text {k}", "en", "a" if k % 2 else None) for k in range(40)] + [(13, "text 13", "en", "a"), (17, "text 17", "en", "a"), (None, "odd", "de", "a")]
    folder = table(spark, tmp_path, rows)
    columns = ["change_id", "file_idx", "doc_id", "plain", "path"]
    found = sorted(map(repr, V.documents(spark, folder, text=True).select(columns).collect()))
    assert found == sorted(map(repr, V.documents(spark, folder).select(columns).collect()))
    assert len(found) == len(set(found)) > len(rows)


def test_parts_of_one_change_are_ordered_in_one_call():
    links = [(0, 0, 1), (0, 1, 2), (5, 3, 4)]
    rows = pd.DataFrame([("c", part, importer, imported, None) for part, importer, imported in links], columns=["change_id", "part", "importer_pos", "imported_pos", "node"])
    found = G.order_group(rows)
    assert found[found.part == 0].pos.tolist() == [2, 1, 0] and found[found.part == 5].pos.tolist() == [4, 3]
    assert set(found.change_id) == {"c"}


def test_rounds_of_the_corpus_graph_broadcast_nothing(spark):
    nodes = spark.range(50).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(k, (k + 1) % 10) for k in range(10)] + [(k, k - 1) for k in range(11, 50)], "src bigint, dst bigint")
    found = G.scc_distributed(nodes, edges, small=0)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.node: r.component for r in found.collect()} == {k: 0 if k < 10 else k for k in range(50)}


def test_source_lines_are_read_where_they_lie(spark, tmp_path, monkeypatch):
    """Parts follow the bytes, not the shuffle partitions; joins and windows over a file's lines keep them."""
    rows = [(k, f"text {k}\nmore" if k % 5 else None, "en", "one" if k % 4 else None) for k in range(60)] + [(13, "again", "en", "one"), (None, "odd\n", "de", "one")]
    folder = table(spark, tmp_path, rows)
    monkeypatch.setattr(C, "PART_BYTES", 64)
    parts = C.text_parts(spark, folder)
    lines = C.source_lines(spark, folder)
    files = V.documents(spark, folder).select("change_id", "file_idx", "path")
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for name, value in changed.items():
            spark.conf.set(name, value)
        assert parts > 4 and I.with_language(lines, files).rdd.getNumPartitions() == parts
        assert "Exchange" not in W.added_runs(lines)._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in changed:
            spark.conf.unset(name)
    # Numbers are those of a count over all lines of a file.
    at = Window.partitionBy("change_id", "file_idx").orderBy("line_idx")
    number = lambda skip: F.when(F.col("t") == skip, 0).otherwise(F.sum((F.col("t") != skip).cast("int")).over(at))
    wrong = (F.col("line_idx") != F.row_number().over(at) - 1) | (F.col("old") != number("a")) | (F.col("new") != number("d"))
    assert lines.withColumn("wrong", wrong).where("wrong IS NULL OR wrong").count() == 0


def test_parts_of_texts_follow_their_bytes(spark, tmp_path, monkeypatch):
    folder = table(spark, tmp_path, [(k, "x" * 100, "en", "one") for k in range(60)])
    assert C.text_parts(spark, folder) == 4
    monkeypatch.setattr(C, "PART_BYTES", 500)
    assert C.text_parts(spark, folder) == 12
