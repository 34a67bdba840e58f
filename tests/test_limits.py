"""Limits that the input may exceed."""

import time

from changeloom.functions.web import html_refs
from changeloom.operators.prepare import pack_batches
from changeloom.sources import patches as P
from changeloom.sources.responses import repair_text
from changeloom.sources.tables import catalog_scan
from changeloom.settings import Settings


def test_hunk_numbers_beyond_32_bits(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -4000000000,1 +4000000001,2 @@\n a\n+b"
    frame = spark.createDataFrame([("c", 0, text)], "change_id string, file_idx int, section string")
    hunk = P.parse_hunks(frame).first()
    assert (hunk.old_start, hunk.new_start) == (4000000000, 4000000001)
    lines = P.parse_lines(frame).orderBy("line_idx").collect()
    assert [(r.t, r.old, r.new) for r in lines] == [("c", 4000000000, 4000000001), ("a", 0, 4000000002)]


def test_batches_larger_than_two_blocks(spark):
    sized = spark.range(13_000).selectExpr(
        "'c' change_id", "cast(id as int) file_idx", "lpad(cast(id as string), 6, '0') path", "1 header_bytes", "1 diff_bytes"
    )
    found = pack_batches(sized, 1_000_000, 9_000).groupBy("batch_idx").count().orderBy("batch_idx").collect()
    assert [r["count"] for r in found] == [9_000, 4_000]


def test_broken_answer_is_repaired_in_linear_time():
    start = time.perf_counter()
    repair_text('{"a": "' + 'x "q" y' * 150_000)
    assert time.perf_counter() - start < 5
    assert repair_text('{"a": "x "q"\n y", "b": 1}') == '{"a": "x \\"q\\"\\n y", "b": 1}'


def test_unfinished_tag_does_not_hide_the_next(spark):
    cases = [("<imgtext <link href=d32.css>", ["d32.css"]), ('x < y <!-- \n--><script src="c95.js">', ["c95.js"]),
             ('x < y \n<script src="c95.js">', ["c95.js"])]
    frame = spark.createDataFrame(cases, "html string, wanted array<string>")
    for row in frame.select(html_refs(frame.html).alias("found"), "wanted").collect():
        assert row.found == row.wanted


def test_catalog_limit_counts_per_repository(spark):
    prs = spark.createDataFrame([("r1", 1, "a", 1), ("r1", 2, "b", 2), ("r2", 3, "c", 0)], "repository string, number int, title string, updated_at int")
    branches = spark.createDataFrame([], "repository string, name string, base string, ahead int, committed_at int, subject string")
    commits = spark.createDataFrame([], "repository string, hash string, short_hash string, committed_at int, subject string")
    found = catalog_scan(prs, branches, commits, Settings(list_limit=1))
    assert sorted((r.repository, r.ref) for r in found.collect()) == [("r1", "2"), ("r2", "3")]
