"""Text functions against plain Python restatements."""

import json
import random
import unicodedata

from pyspark.sql import functions as F

from changeloom.functions import text as T
from changeloom.functions import web as W
from changeloom.functions.paths import clean_path, normalize_path, repo_identity
from changeloom.sources.responses import repair_text


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values))
    return frame.select(column.alias("x")).first().x


def is_word(char):
    return char == "_" or unicodedata.category(char)[0] == "L" or unicodedata.category(char) == "Nd"


def spans(old, new):
    """Character loops over both lines."""
    if old == new:
        return None
    p = 0
    while p < min(len(old), len(new)) and old[p] == new[p]:
        p += 1
    s = 0
    while s < min(len(old), len(new)) - p and old[-1 - s] == new[-1 - s]:
        s += 1
    solid = lambda t: sum(not c.isspace() for c in t)
    short = min(solid(old), solid(new))
    if short and (solid(old[:p]) + solid(old[len(old) - s:])) / short < 0.5:
        return None
    while p and is_word(old[p - 1]) and any(p < len(t) and is_word(t[p]) for t in (old, new)):
        p -= 1
    while s and is_word(old[len(old) - s]) and any(
        len(t) - s - 1 >= p and is_word(t[len(t) - s - 1]) for t in (old, new)
    ):
        s -= 1
    return p, len(old) - s, len(new) - s


def test_changed_spans_on_random_edits(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        old = "".join(rng.choice("ab_ é.😀(1") for _ in range(rng.randint(0, 14)))
        at, cut = rng.randint(0, len(old)), rng.randint(0, 3)
        new = old[:at] + "".join(rng.choice("ab (é😀") for _ in range(rng.randint(0, 3))) + old[at + cut:]
        rows.append((i, old, new))
    frame = spark.createDataFrame(rows, "i int, o string, n string")
    got = {r.i: (r.start, r.old_end, r.new_end) for r in T.changed_spans(frame, "o", "n", 4096, 0.5).collect()}
    assert got == {i: s for i, o, n in rows if (s := spans(o, n)) is not None}


def test_long_lines_have_no_spans(spark):
    frame = spark.createDataFrame([("x" * 5000, "x" * 5001)], "o string, n string")
    assert T.changed_spans(frame, "o", "n", 4096, 0.5).count() == 0


def test_utf8_truncate_never_splits_a_character(spark):
    text = "aé€😀" * 3
    for limit in range(0, 32):
        expected = text.encode()[:limit].decode(errors="ignore")
        assert one(spark, T.utf8_truncate(F.col("t"), F.lit(limit)), t=text) == expected


def test_size_labels(spark):
    cases = {0: "0 B", 999: "999 B", 1000: "1.0 KB", 1050: f"{1.05:.1f} KB", 1950: f"{1.95:.1f} KB", 1250: "1.2 KB",
             1750: "1.8 KB", 999_999: "1000.0 KB", 1_000_000: "1.0 MB", 2_450_000: f"{2.45:.1f} MB"}
    frame = spark.createDataFrame([(k,) for k in cases], "n bigint")
    assert {r.n: r.x for r in frame.select("n", T.size_label(F.col("n")).alias("x")).collect()} == cases


def test_json_string_is_markup_safe(spark):
    value = 'a"b\\c<d>&\n '
    text = one(spark, T.json_string(F.col("t")), t=value)
    assert json.loads(text) == value and not set("<>&") & set(text)


def test_repair_of_answers():
    assert json.loads(repair_text('{"a": "x\ny\tz", "b": 1}')) == {"a": "x\ny\tz", "b": 1}
    assert json.loads(repair_text('{"a": "say "hi" now", "b": ["c"d", "e"]}')) == {"a": 'say "hi" now', "b": ['c"d', "e"]}
    fine = '{"a": "q\\"\\n", "b": {"c": []}}'
    assert repair_text(fine) == fine
    assert repair_text('{"a": "open') == '{"a": "open'
    assert repair_text('{"a": "' + "x\n" * 200_000 + '"}').count("\\n") == 200_000


def test_paths(spark):
    cases = {"./a/../b": "b", "/x//y/": "x/y", "a\\b": "a/b", ".": "", "": "", "../a": "../a", "a/../../b": "../b"}
    for raw, expected in cases.items():
        assert one(spark, normalize_path(F.col("p")), p=raw) == expected, raw
    assert one(spark, clean_path(F.col("p")), p="a/./b/../c") == "a/c"


def test_repository_identity(spark):
    cases = {"git@Host.com:own/name.git": "host.com/own/name", "https://u@Host.com:8/own/name/pull/3": "host.com/own/name",
             "ssh://git@h/own": "", "nonsense": "", "host:/a/b": "host/a/b"}
    for raw, expected in cases.items():
        assert one(spark, repo_identity(F.col("u")), u=raw) == expected, raw


def test_html_references(spark):
    html = ("<!-- <img src='no.png'> --><SCRIPT async src=a.js>var x='<img src=\"no\">';</script>"
            "<style>img{}<img src='no'></style><link rel=x\n href='b.css'><img alt='>' data-src='no' src=\"c.png\">"
            "<img src='/root.png'><img src='http://h/x.png'><img src='#x'><script src='d.js'>")
    assert one(spark, W.html_refs(F.col("t")), t=html) == ["a.js", "b.css", "c.png", "d.js"]


def test_css_references(spark):
    css = ("/* url(no) */@import 'a.css';@IMPORT /* c */ \"b.css\";.x{background:URL( 'c.png' ) url(d.png)"
           ";content:\"url(no)\"}url(/no) url(data:no)")
    assert one(spark, W.css_refs(F.col("t")), t=css) == ["a.css", "b.css", "c.png", "d.png"]


def test_long_tags_do_not_overflow(spark):
    tag = "<img " + "a='b' " * 60_000 + "src='x.png'>"
    assert one(spark, W.html_refs(F.col("t")), t=tag + "<!--" + "-" * 300_000) == ["x.png"]
    assert one(spark, W.css_refs(F.col("t")), t="\"" + "a\\\"" * 200_000) == []


def test_a_sign_in_plain_text_opens_a_tag_and_hides_comments(spark):
    cases = {
        'x < y <!-- \n<script src="c95.js">': ["c95.js"],
        '<p>don\'t</p><!-- <img src="./no.svg"> --><img src="a.svg">': ["a.svg"],
        '<a title="<!--"><img src="b.svg"><!-- <img src="no.svg">': ["b.svg"],
        '<img alt=\'src="./no.svg"\'>': [],
    }
    for html, wanted in cases.items():
        assert one(spark, W.html_refs(F.col("t")), t=html) == wanted, html
