"""Cases that a cut would hide: short lines, ends of long texts, a benchmark of many blocks."""

import math
import random
import re
from collections import Counter

import pytest

from changeloom.llm import automata, line_join, winnow

WORDS = "ash birch cedar elm fir hazel larch maple oak pine".split()


def brute_force(texts):
    expected, before = set(), []
    for k, text in enumerate(texts):
        for number, line in enumerate((text or "").split("\n")):
            words = set(line.encode().lower().split())
            if words and any(100 * len(words & x) >= 80 * len(words | x) for x in before):
                expected.add((k, number))
            if words:
                before.append(words)
    return expected


def test_lines_of_few_words_are_judged(spark):
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 7)))
    texts = [None, "", "All rights reserved.", "x", "only once", "Oak oak OAK oak oak", "all RIGHTS  reserved.\nx\n\nx y", "ash elm fir oak", "ash elm fir oak yew", "oak"]
    texts += ["\n".join(say() for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["the\nof the\nthe of"] * 9
    # Words at the top of the count table.
    texts += [" ".join(["the of"] * 9_000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in line_join.line_report(frame).collect()}
    expected = brute_force(texts)
    assert {(k, int(x)) for k, r in found.items() for x in r.removed_lines.split(",") if x} == expected
    assert {(6, 0), (6, 1), (8, 0), (9, 0)} <= expected


def test_ordinary_text_counts_whole_texts_of_all_rows(spark):
    rng = random.Random(9)
    say = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [None, "", "é 日本", *(say("abcxyz012 .", 50) for _ in range(1_500)), say("abc xyz", 5_000) + say("ABCXYZ+/_= é-", 30_000)]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    secret = re.compile("[A-Za-z0-9+/_.=-]")
    kinds = lambda t: [automata.symbol(chr(b)) if secret.match(chr(b)) and b < 128 else automata.ALPHABET - 1 for b in t.encode()]
    counts = Counter(pair for t in texts for pair in zip([automata.ALPHABET - 1, *kinds(t or "")], kinds(t or "")))
    every = range(automata.ALPHABET)
    found = automata.ordinary_text(frame)
    for a in every:
        total = sum(counts[a, b] + 1 for b in every)
        assert found[a] == pytest.approx([math.log((counts[a, b] + 1) / total) for b in every])
    assert automata.ordinary_text(frame.limit(0))[3][4] == pytest.approx(math.log(1 / automata.ALPHABET))


def test_benchmark_blocks_are_held_one_at_a_time(spark, monkeypatch):
    steps = []
    prepare, materialize = winnow.prepare, winnow.materialize
    monkeypatch.setattr(winnow, "prepare", lambda texts: steps.append("block") or prepare(texts))
    monkeypatch.setattr(winnow, "materialize", lambda frame, name: steps.append("written") or materialize(frame, name))
    items = [(k, f"{WORDS[k]} wood item{k} stands here") for k in range(9)]
    texts = [f"see {text} and more" for _, text in items] + ["nothing of it", None]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = winnow.contamination(documents, spark.createDataFrame(items, "item_id long, text string"), block_bytes=80)
    blocks = steps.count("block")
    assert blocks > 2 and steps == ["block", "written"] * (blocks - 1) + ["block"]
    assert {r.doc_id for r in found.collect() if r.contaminated} == set(range(9))
