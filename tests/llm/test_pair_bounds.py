"""Ranked search against scores of every document in plain integers."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from changeloom.llm import pair_bounds

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item_id long, score long, rank int"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(documents, items, most):
    docs = [(k, Counter(terms(t))) for k, t in documents]
    held = [(k, c) for k, c in docs if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in set(items):
        ranked = []
        for k, c in held:
            m = 75 + 25 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0 and k is not None:
                ranked.append((-score, k))
        out |= {(item, place, k, -s) for place, (s, k) in enumerate(sorted(ranked)[:most], 1)}
    return out


def make(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Größe", "日本", "x1", "The"]
    say = lambda n: " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(n))
    texts = [None, "", " ,.-", "the", "THE the  größe", "a" * 3_000] + [say(rng.randint(1, 60)) for _ in range(250)] + [say(4_000)]
    texts += texts[20:24] * 12
    documents = [(k, t) for k, t in enumerate(texts)] + [(None, "the w0"), (7, say(9)), (7, texts[7])]
    items = [(k, say(rng.randint(1, 25))) for k in range(12)] + [(90, None), (91, ""), (92, "nowhere"), (93, "the THE w1 w1 w1"), (93, "the THE w1 w1 w1"), (94, texts[20]), (95, "日本 Größe")]
    return documents, items


@pytest.mark.parametrize("shard, block, pairs", [(4 << 20, 4 << 20, 8), (2_000, 150, 12), (500, 4 << 20, 0)])
def test_equals_scores_of_all_documents(spark, monkeypatch, shard, block, pairs):
    for name, value in (("SHARD_BYTES", shard), ("QUERY_BYTES", block), ("PAIRED", pairs)):
        monkeypatch.setattr(pair_bounds, name, value)
    documents, items = make(pairs)
    frame = spark.createDataFrame([(k, t, 5, 6, 7) for k, t in documents], SCHEMA).repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", pair_bounds.F.lit(1))
    found = pair_bounds.rank(frame, benchmark, 20)
    assert {tuple(r) for r in found.collect()} == brute_force(documents, items, 20)
    assert found.count() == found.select("item_id", "rank").distinct().count()
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_empty_tables(spark):
    documents = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert [tuple(r)[:3] for r in pair_bounds.rank(documents, items).collect()] == [(1, 1, 1)]
    for left, right in ((documents.limit(0), items), (documents, items.limit(0)), (documents.where("text is null"), items)):
        assert pair_bounds.rank(left, right).count() == 0


def shard_of(postings, pairs):
    n = 1 + max(d for docs in postings for d in docs)
    flat = [sorted(p.items()) for p in postings]
    lists = [sorted(set(postings[i]) & set(postings[j])) for i, j in pairs]
    return pair_bounds.Shard({
        "ids": list(range(n)), "terms": np.arange(len(postings), dtype="<i4").tobytes(),
        "ends": np.cumsum([len(p) for p in flat]).astype("<i8").tobytes(),
        "docs": np.array([d for p in flat for d, _ in p], "<i4").tobytes(), "impacts": np.array([s for p in flat for _, s in p], "<i8").tobytes(),
        "maxima": np.array([max(p.values()) for p in postings], "<i8").tobytes(), "pairs": np.array(pairs, "<i4").tobytes(),
        "pair_ends": np.cumsum([len(x) for x in lists]).astype("<i8").tobytes(), "pair_docs": np.array(sum(lists, []), "<i4").tobytes(),
        "joint": np.array([max([postings[i][d] + postings[j][d] for d in x], default=0) for (i, j), x in zip(pairs, lists)], "<i8").tobytes(),
    })


def test_joint_maxima_leave_fewer_candidates():
    # Two words that never meet: neither alone, nor both bounds coupled, reach the last place.
    postings = [{k: 60 for k in range(0, 50)}, {k: 60 for k in range(50, 100)}, {100: 200, 3: 100}]
    with_pairs, without = shard_of(postings, [(0, 1), (0, 2)]), shard_of(postings, [])
    ids, scores, tried = pair_bounds.search_shard(with_pairs, [0, 1, 2], [1, 1, 1], 110, 2)
    assert dict(zip(ids.tolist(), scores.tolist())) == {100: 200, 3: 160} and tried == 2
    again, same, more = pair_bounds.search_shard(without, [0, 1, 2], [1, 1, 1], 110, 2)
    assert dict(zip(again.tolist(), same.tolist())) == {100: 200, 3: 160} and more > tried
