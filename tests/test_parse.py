"""Parsing of unified diffs: literal cases and a counter-loop check on random hunks."""

import random

from changeloom.sources import patches as P

PATCH = "\n".join([
    "From: someone", "Subject: several changes", "",
    "diff --git a/one.txt b/one.txt", "new file mode 100644", "--- /dev/null", "+++ b/one.txt",
    "@@ -0,0 +1,2 @@", "+hello", "+world",
    "diff --git a/gone.py b/gone.py", "deleted file mode 100644", "--- a/gone.py", "+++ /dev/null",
    "@@ -1 +0,0 @@", "-bye",
    "diff --git a/a.go b/b.go", "similarity index 91%", "rename from a.go", "rename to b.go",
    "--- a/a.go", "+++ b/b.go", "@@ -5,2 +5,2 @@ func main() {", "-\told", "+\tnew", " \tsame",
    "diff --git a/pic.png b/pic.png", "Binary files a/pic.png and b/pic.png differ",
    'diff --git "a/na\\303\\257ve \\"x\\".md" "b/na\\303\\257ve \\"x\\".md"', "@@ -1 +1 @@ ctx", "-a", "+b",
    "\\ No newline at end of file",
    "diff --git a/run.sh b/run.sh", "old mode 100644", "new mode 100755",
    "diff --git a/d b/f.txt b/d b/f.txt", "@@ -1,1 +1,1 @@", "--- minus", "+++ plus", "+trailer is ignored",
]) + "\n"


def read(spark, tmp_path, text, name="x.patch"):
    (tmp_path / name).write_text(text, newline="")
    return P.read_patches(spark, str(tmp_path))


def test_files_of_a_patch(spark, tmp_path):
    rows = P.parse_files(read(spark, tmp_path, PATCH)).orderBy("file_idx").collect()
    seen = [(r.path, r.old_path, r.status, r.binary, r.similarity, r.mode_changed) for r in rows]
    assert seen == [
        ("one.txt", "one.txt", "added", False, 0, False),
        ("gone.py", "gone.py", "deleted", False, 0, False),
        ("b.go", "a.go", "renamed", False, 91, False),
        ("pic.png", "pic.png", "modified", True, 0, False),
        ('naïve "x".md', 'naïve "x".md', "modified", False, 0, False),
        ("run.sh", "run.sh", "modified", False, 0, True),
        ("d b/f.txt", "d b/f.txt", "modified", False, 0, False),
    ]


def test_lines_of_a_patch(spark, tmp_path):
    rows = P.parse_lines(read(spark, tmp_path, PATCH)).orderBy("file_idx", "line_idx").collect()
    seen = [(r.file_idx, r.t, r.old, r.new, r.text) for r in rows]
    assert seen == [
        (0, "a", 0, 1, "hello"), (0, "a", 0, 2, "world"), (1, "d", 1, 0, "bye"),
        (2, "d", 5, 0, "\told"), (2, "a", 0, 5, "\tnew"), (2, "c", 6, 6, "\tsame"),
        (4, "d", 1, 0, "a"), (4, "a", 0, 1, "b"), (6, "d", 1, 0, "-- minus"), (6, "a", 0, 1, "++ plus"),
    ]


def test_carriage_returns_do_not_matter(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "w").mkdir()
    unix = read(spark, tmp_path / "u", PATCH)
    dos = read(spark, tmp_path / "w", PATCH.replace("\n", "\r\n"))
    for parse in (P.parse_files, P.parse_hunks, P.parse_lines):
        left = [tuple(r) for r in parse(unix).drop("change_id").collect()]
        right = [tuple(r) for r in parse(dos).drop("change_id").collect()]
        assert sorted(map(str, left)) == sorted(map(str, right))


def test_one_large_patch_splits_and_keeps_its_order(spark, tmp_path):
    text = "".join(f"diff --git a/f{i} b/f{i}\n@@ -1 +1 @@\n-{'x' * 50}\n+{i}\n" for i in range(3000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        sections = read(spark, tmp_path, text)
        assert sections.rdd.getNumPartitions() > 3
        rows = P.parse_files(sections).select("file_idx", "path").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.file_idx: r.path for r in rows} == {i: f"f{i}" for i in range(3000)}


def counted(body, old, new, a, b):
    """The two remaining counts, line by line."""
    rows, left, right = [], a, b
    for line in body:
        if left == 0 and right == 0:
            break
        if line[:1] == "+":
            rows.append(("a", 0, new, line[1:]))
            new, right = new + 1, right - 1
        elif line[:1] == "-":
            rows.append(("d", old, 0, line[1:]))
            old, left = old + 1, left - 1
        elif line[:1] == " ":
            rows.append(("c", old, new, line[1:]))
            old, new, left, right = old + 1, new + 1, left - 1, right - 1
    return rows


def test_random_hunks_with_wrong_counts(spark):
    rng = random.Random(5)
    sections, expected = [], {}
    for i in range(300):
        body = [rng.choice("+- \\") + str(k) for k in range(rng.randint(0, 9))]
        a, b = rng.randint(0, 5), rng.randint(0, 5)
        sections.append(("c", i, "\n".join([f"diff --git a/{i} b/{i}", f"@@ -3,{a} +7,{b} @@", *body])))
        expected[i] = counted(body, 3, 7, a, b)
    frame = spark.createDataFrame(sections, "change_id string, file_idx int, section string")
    got = {i: [] for i in expected}
    for r in P.parse_lines(frame).orderBy("file_idx", "line_idx").collect():
        got[r.file_idx].append((r.t, r.old, r.new, r.text))
    assert got == expected


def test_broken_header_is_an_error_of_its_change_only(spark):
    rows = [("good", 0, "diff --git a/x b/x\n"), ("bad", 0, "diff --git x\n"), ("bad2", 0, 'diff --git "a/x b/x\n'),
            ("bad3", 0, 'diff --git "a/x\\q" "b/x\\q"\n'), ("fine", 0, 'diff --git "a/\\303\\274\\t\\x41" "b/\\u00fc\\U0001F600"\n')]
    frame = spark.createDataFrame(rows, "change_id string, file_idx int, section string")
    assert {r.change_id for r in P.parse_errors(frame).collect()} == {"bad", "bad2", "bad3"}
    fine = P.parse_files(frame).where("change_id = 'fine'").first()
    assert (fine.old_path, fine.new_path) == ("ü\tA", "ü😀")


def test_long_lines_do_not_overflow(spark):
    big = "x" * 1_000_000
    section = f"diff --git a/b b/b\n@@ -1 +1,2 @@\n-{big}\n+{big}\n+<{'a ' * 400_000}\n"
    frame = spark.createDataFrame([("c", 0, section)], "change_id string, file_idx int, section string")
    assert [r.n for r in P.parse_lines(frame).selectExpr("length(text) n").collect()] == [1000000, 1000000, 800001]
