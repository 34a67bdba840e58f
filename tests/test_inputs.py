"""Texts cut before they are gathered, batches of any length, asset files by side."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from changeloom.functions.text import cap_inside, cap_outside
from changeloom.operators import prepare as P
from changeloom.operators.aggregate import diff_text
from changeloom.sources.tables import append_cache, asked_entries, asset_inventory, cache_lookup, read_assets

FILES = "change_id string, file_idx int, binary boolean"
HUNKS = "change_id string, file_idx int, hunk_idx int, header string"
LINES = "change_id string, file_idx int, hunk_idx int, line_idx int, t string, text string"


@pytest.mark.parametrize("cap", [0, 1, 40, 200, 100_000])
def test_cut_text_gives_the_same_cuts(spark, cap):
    rng = random.Random(cap)
    files = [("c", i, i == 3) for i in range(12)]
    hunks = [("c", i, h, rng.choice(["", "fn é"])) for i in range(11) if i != 3 for h in range(rng.randrange(6))]
    lines = [
        (c, i, h, k, rng.choice("acd"), rng.choice(["", "x", "日本語" * 5, "word " * 40, "z" * 900]))
        for c, i, h, _ in hunks for k in range(rng.randrange(30))
    ]
    tables = [spark.createDataFrame(r, s) for r, s in ((lines, LINES), (hunks, HUNKS), (files, FILES))]
    whole, cut = diff_text(*tables), diff_text(*tables, cap)
    for limit in sorted({0, cap // 2, cap}):
        shown = [
            sorted(map(tuple, texts.select("file_idx", cap_inside(F.col("diff"), F.lit(limit)), cap_outside(F.col("diff"), F.lit(limit))).collect()))
            for texts in (whole, cut)
        ]
        assert shown[0] == shown[1] and len(shown[0]) == 12
    longest = cut.where("file_idx <> 3").agg(F.max(F.octet_length("diff"))).first()[0]
    assert longest <= cap + 4 * (cap + 1) + 10  # one row more: a header, or a line of cap + 1 letters
    expected = {}
    for c, i, h, header in hunks:
        body = "".join({"a": "+", "d": "-", "c": " "}[t] + x + "\n" for _, j, g, _, t, x in lines if (j, g) == (i, h))
        expected[i] = expected.get(i, "") + f"@@ {header}\n{body}"
    got = {r.file_idx: r["diff"] for r in whole.collect()}
    assert got == {i: "(binary file)\n" if b else expected.get(i, "") for _, i, b in files}


@pytest.mark.parametrize(("block", "most"), [(8, 3), (16, 100_000)])
def test_batches_follow_blocks_by_doubling(spark, monkeypatch, block, most):
    """One change over dozens of blocks, batches longer and shorter than a block, empty files."""
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(block * most)
    sizes = [(rng.randrange(4), rng.choice([0, 0, 1, 5, 30])) for _ in range(300)]
    rows = [("c", i, f"{i:04d}", *s) for i, s in enumerate(sizes)] + [("d", 0, "p", 200, 9)]
    sized = spark.createDataFrame(rows, "change_id string, file_idx int, path string, header_bytes int, diff_bytes int")
    wanted, batch, used, pos = [], 0, 0, 0
    for i, (head, diff) in enumerate(sizes):
        if pos and (pos == most or used + head + diff > 60):
            batch, used, pos = batch + 1, 0, 0
        limit = min(diff, max(60 - used - head, 0)) if pos == 0 else diff
        wanted.append(("c", batch, pos, i, limit))
        used, pos = used + head + limit, pos + 1
    wanted.append(("d", 0, 0, 0, 0))
    for bounded in (True, False):
        got = P.pack_batches(sized, 60, most, bounded).select("change_id", "batch_idx", "pos", "file_idx", "diff_limit")
        assert sorted(map(tuple, got.collect())) == wanted


def test_batches_of_no_files(spark):
    sized = spark.createDataFrame([], "change_id string, file_idx int, path string, header_bytes int, diff_bytes int")
    assert P.pack_batches(sized, 60, bounded=False).count() == 0


def test_assets_by_side(spark, tmp_path):
    for change, side, name, size in (("a%2Fb", "old", "img/old/x y.png", 3), ("a%2Fb", "new", "img/x.png", 2500), ("k", "new", "n.bin", 7), ("k", "new", "none.bin", 0)):
        file = tmp_path / f"change_id={change}" / f"side={side}" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x" * size)
    (tmp_path / "notes.txt").write_text("no asset")
    sides = read_assets(spark, str(tmp_path))
    assert sorted(map(tuple, sides.collect())) == [
        ("a/b", "new", "img/x.png", 2500), ("a/b", "old", "img/old/x y.png", 3), ("k", "new", "n.bin", 7)]
    plan = sides._jdf.queryExecution().toString()
    assert "content" not in plan[plan.index("Physical Plan"):]

    files = spark.createDataFrame(
        [("a/b", 0, "img/x.png", "img/old/x y.png", "img/x.png", "renamed", True), ("k", 0, "n.bin", "n.bin", "n.bin", "added", True),
         ("k", 1, "gone.png", "gone.png", "gone.png", "modified", True), ("k", 2, "t.txt", "t.txt", "t.txt", "added", False)],
        "change_id string, file_idx int, path string, old_path string, new_path string, status string, binary boolean")
    split = [sides.where(F.col("side") == side) for side in ("old", "new")]
    found = {(r.change_id, r.file_idx): (r.old_size, r.new_size, r.label) for r in asset_inventory(files, *split).collect()}
    assert found[("a/b", 0)][:2] == (3, 2500) and found[("k", 0)][:2] == (None, 7) and len(found) == 3
    assert found[("k", 1)][2] == "Binary image · one or more sides unavailable"
    alone = {(r.change_id, r.file_idx): (r.image, r.label) for r in asset_inventory(files, None, None).collect()}
    assert alone[("k", 1)] == (True, "Binary image · content not available from patch input.")
    assert alone[("k", 0)] == (False, "Binary file · content not available from patch input.")


def test_store_reads_only_the_asked_folders(spark, tmp_path):
    schema = StructType.fromDDL("key string, path string, mtime long, schema_version int, staged boolean")
    keys = ["00aa", "00bb", "1e00", "ffff", "not hex", None]
    first = spark.createDataFrame([(k, f"{k}-1", 1, 6, True) for k in keys], schema)
    later = spark.createDataFrame([("00aa", "00aa-2", 2, 6, False), ("1e00", "1e00-2", 2, 5, True)], schema)
    requests = spark.createDataFrame([(1, "00aa"), (2, "00aa"), (3, "1e00"), (4, "not hex"), (5, "0000"), (6, None)], "id int, key string")
    root = str(tmp_path / "store")
    none = cache_lookup(requests, asked_entries(spark, root, schema, requests)).collect()
    assert len(none) == 6 and not any(r.cached for r in none)
    append_cache(first, root)
    append_cache(later, root)
    entries = asked_entries(spark, root, schema, requests)
    got = {r.id: (r.entry_path, r.entry_staged) for r in cache_lookup(requests, entries).collect()}
    assert got == {1: ("00aa-2", False), 2: ("00aa-2", False), 3: ("1e00-1", True), 4: ("not hex-1", True), 5: (None, None), 6: (None, None)}
    one = asked_entries(spark, root, schema, requests.where("id = 3"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "= 1e" in plan
    assert [r.path for r in one.orderBy("path").collect()] == ["1e00-1", "1e00-2"]
