"""Orders, components, batches and budgets against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from changeloom.operators import assemble as S
from changeloom.operators import graph as G
from changeloom.operators import prepare as P
from changeloom.operators import windows as W
from changeloom.operators.ranking import rank_rows


def reach(n, edges):
    seen = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            seen[a] |= seen[b]
    return seen


def slow_order(n, edges):
    """Take the first unplaced file whose dependencies are placed, again and again."""
    seen = reach(n, edges)
    same = lambda a, b: b in seen[a] and a in seen[b]
    waits = {(a, b) for a, b in edges if a != b and not same(a, b)}
    for a in range(n):
        before = [b for b in range(a) if same(a, b)]
        if before:
            waits.add((a, before[-1]))
    placed = []
    while len(placed) < n:
        free = [i for i in range(n) if i not in placed and all(b in placed for a, b in waits if a == i)]
        if not free:
            return list(range(n))
        placed.append(free[0])
    return placed


def random_graphs(count, n, rng):
    return {f"g{k}": {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 14))} for k in range(count)}


def test_stable_order_on_random_graphs(spark):
    n, graphs = 9, random_graphs(60, 9, random.Random(1))
    items = spark.createDataFrame([(g, 0, i, i) for g in graphs for i in range(n)], "change_id string, part int, file_idx int, pos int")
    edges = spark.createDataFrame([(g, a, b) for g, es in graphs.items() for a, b in es], "change_id string, importer int, imported int")
    got = {}
    for r in G.stable_order(items, edges).orderBy("change_id", "new_pos").collect():
        got.setdefault(r.change_id, []).append(r.file_idx)
    assert got == {g: slow_order(n, es) for g, es in graphs.items()}


def test_components_both_ways(spark):
    n, graphs = 8, random_graphs(25, 8, random.Random(2))
    expected = {(g, i): min(j for j in range(n) if j in s[i] and i in s[j]) for g, es in graphs.items() for s in [reach(n, es)] for i in range(n)}
    nodes = spark.createDataFrame([(g, i) for g in graphs for i in range(n)], "change_id string, node int")
    edges = spark.createDataFrame([(g, a, b) for g, es in graphs.items() for a, b in es], "change_id string, importer int, imported int")
    got = {(r.change_id, r.node): r.component for r in G.scc(nodes, edges).collect()}
    assert got == expected
    # All graphs as one, their nodes in disjoint ranges; no task may close more than a few links.
    flat = spark.createDataFrame([(100 * k + i,) for k in range(len(graphs)) for i in range(n)], "node bigint")
    links = spark.createDataFrame([(100 * k + a, 100 * k + b) for k, es in enumerate(graphs.values()) for a, b in [*es, (0, 0)]], "src bigint, dst bigint")
    for small in (0, 200_000):
        whole = {r.node: r.component for r in G.scc_distributed(flat, links, small).collect()}
        assert whole == {100 * k + i: 100 * k + expected[(g, i)] for k, g in enumerate(graphs) for i in range(n)}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A path of 3,000 nodes that ends in a ring of 1,000 others."""
    rounds, contract = [], G.contract
    monkeypatch.setattr(G, "contract", lambda *a: rounds.append(1) or contract(*a))
    rng = random.Random(5)
    names = rng.sample(range(10_000), 4_000)
    pairs = list(zip(names, names[1:])) + [(names[-1], names[3_000])]
    nodes, links = spark.createDataFrame([(x,) for x in names], "node bigint"), spark.createDataFrame(pairs, "src bigint, dst bigint")
    got = {r.node: r.component for r in G.scc_distributed(nodes, links, 10).collect()}
    ring = names[3_000:]
    assert got == {x: min(ring) if x in set(ring) else x for x in names}
    assert len(rounds) < 30


def test_cohort_order_keeps_dependencies_first(spark):
    rng = random.Random(4)
    files = [(f"c{k}", c, c * 3 + p, p) for k in range(20) for c in range(6) for p in range(3)]
    edges = [(f"c{k}", rng.randrange(18), rng.randrange(18)) for k in range(20) for _ in range(8)]
    cohort_files = spark.createDataFrame([(a, b, c, d) for a, b, c, d in files], "change_id string, cohort_idx int, file_idx int, pos int")
    frame = spark.createDataFrame(edges, "change_id string, importer int, imported int")
    order, deps = G.stable_cohort_order(frame, cohort_files)
    place = {(r.change_id, r.cohort_idx): r.new_idx for r in order.collect()}
    for k in range(20):
        links = {(a // 3, b // 3) for c, a, b in edges if c == f"c{k}" and a // 3 != b // 3}
        assert [c for _, c in sorted((place[(f"c{k}", c)], c) for c in range(6))] == slow_order(6, links)
    assert all(r.dep_idx < r.cohort_idx and r.rank <= 3 for r in deps.collect())


def slow_pack(files, budget, most):
    out, batch, used = [], [], 0
    for name, (path, head, diff) in sorted(files.items(), key=lambda x: (x[1][0], x[0])):
        if batch and (len(batch) == most or used + head + diff > budget):
            out.append(batch)
            batch, used = [], 0
        limit = min(diff, max(budget - used - head, 0))
        batch.append((name, limit))
        used += head + limit
    return out + [batch] if batch else out


@pytest.mark.parametrize(("block", "bounded"), [(4096, True), (7, True), (7, False)])
def test_pack_batches(spark, monkeypatch, block, bounded):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(6)
    changes = {f"c{k}": {i: (f"p{rng.randrange(40):02d}", rng.randint(1, 9), rng.choice([0, 3, 20, 90])) for i in range(rng.choice([1, 6, 50]))} for k in range(12)}
    rows = [(c, i, *f) for c, fs in changes.items() for i, f in fs.items()]
    sized = spark.createDataFrame(rows, "change_id string, file_idx int, path string, header_bytes int, diff_bytes int")
    got = {}
    for r in P.pack_batches(sized, 60, 4, bounded).orderBy("change_id", "batch_idx", "pos").collect():
        got.setdefault(r.change_id, {}).setdefault(r.batch_idx, []).append((r.file_idx, r.diff_limit))
    assert {c: list(b.values()) for c, b in got.items()} == {c: slow_pack(f, 60, 4) for c, f in changes.items()}


def test_ranks_do_not_depend_on_how_groups_are_split(spark):
    """Nine of ten rows are in one group."""
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.9 else f"g{rng.randrange(5)}", i, rng.randrange(1000), rng.randrange(9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, i int, k int, v int")
    seen = [
        sorted(map(tuple, rank_rows(frame, ["g"], ["k", "i"], "rank", {"upto": "v"}, bounded).select("g", "i", "rank", "upto").collect()))
        for bounded in (True, False)
    ]
    assert seen[0] == seen[1]
    kept = [W.prefix_budget(frame, ["g"], ["k", "i"], "v", 500, bounded).count() for bounded in (True, False)]
    assert kept[0] == kept[1]


def test_fair_share_keeps_every_cohort_within_budget(spark):
    changes = spark.createDataFrame([("c", "Titel", "Zeile")], "change_id string, title string, description string")
    rows = [("c", i, "api", f"Überschrift {i}", "lange Erklärung " * 40, "Zweck", ["Risiko"] if i % 2 else [], i) for i in range(12)]
    told = spark.createDataFrame(rows, "change_id string, cohort_idx int, layer string, title string, narrative string, intent string, review_notes array<string>, files int")
    for budget in (200, 500, 1500, 9000):
        text = P.fair_share(changes, told, budget).first().text
        assert len(text.encode()) <= budget
        if budget >= 500:
            assert all(f"COHORT[{i}] l=api t=" in text for i in range(12))
    assert "f=11" in text and "n=lange" in text


def test_fair_share_spends_left_over_bytes_in_order(spark):
    """Texts written by hand."""
    changes = spark.createDataFrame([("c", "T", None)], "change_id string, title string, description string")
    rows = [("c", 0, "api", "abcdef", "", "", None, 1), ("c", 1, "api", "ü" * 90, "new\nline", "why", [], 2)]
    told = spark.createDataFrame(rows, "change_id string, cohort_idx int, layer string, title string, narrative string, intent string, review_notes array<string>, files int")
    head = 'CHANGE_TITLE_JSON: "T"\nDESCRIPTION_JSON: ""\nCOHORTS: 2\n'
    first = "COHORT[0] l=api t=abcd title=abcdef f=1\n"
    whole = head + first + "COHORT[1] l=api t=üü title=" + "ü" * 55 + "... n=new line i=why f=2\n"
    assert P.fair_share(changes, told, 3000).first().text == whole
    # Nine bytes left over: four for the first cohort, too few for "title=", then all for the second.
    compact = "COHORT[0] l=api t=abcd\n", "COHORT[1] l=api t=üü\n"
    budget = len((head + "".join(compact)).encode()) + 9
    assert P.fair_share(changes, told, budget, P.Settings(digest_max_chars=budget)).first().text == head + compact[0] + "COHORT[1] l=api t=üü title=ü\n"
    assert P.fair_share(changes, told, 12).first().text == "COHORT[0] l="


def test_preview_budget_passes_over_what_does_not_fit(spark):
    from changeloom.settings import Settings

    rows = [("c", 0, "a.png", None, 50), ("c", 1, "b.png", 60, 30), ("c", 2, "c.bin", 1, 1), ("c", 3, "d.gif", 20, 101)]
    frame = spark.createDataFrame(rows, "change_id string, file_idx int, path string, old_size int, new_size int")
    got = P.preview_budget(frame, Settings(max_preview_bytes=100, max_total_preview_bytes=100)).collect()
    assert sorted((r.file_idx, r.side) for r in got) == [(0, 1), (1, 1), (3, 0)]


def test_refined_cohorts_keep_every_file_once(spark):
    ops = '[{"op":"merge","into":2,"from":0},{"op":"merge","into":0,"from":3},{"op":"retitle","cohort":3,"title":"T"}]'
    outcome = S.cohort_ops(
        S.decode_ops(spark.createDataFrame([("c", ops)], "change_id string, ops string")),
        spark.createDataFrame([("c", 4)], "change_id string, cohorts int"),
    )
    files = spark.createDataFrame([("c", k // 2, k % 2, k) for k in range(8)], "change_id string, cohort_idx int, pos int, file_idx int")
    told = spark.createDataFrame(
        [("c", k, f"t{k}", "api", "i", "n", [f"n{k}", "all"], k == 3) for k in range(4)],
        "change_id string, cohort_idx int, title string, layer string, intent string, narrative string, review_notes array<string>, stubbed boolean",
    )
    placed, narrations = S.apply_cohort_ops(files, told, outcome)
    rows = placed.orderBy("cohort_idx", "pos").collect()
    assert [r.file_idx for r in rows] == [2, 3, 4, 5, 0, 1, 6, 7]
    names = {r.cohort_idx: (r.title, r.review_notes, r.stubbed) for r in narrations.collect()}
    assert names == {0: ("t1", ["n1", "all"], False), 1: ("T", ["n2", "all", "n0", "n3"], True)}


def test_flow_depth(spark):
    cohorts = spark.createDataFrame([("c", i) for i in range(6)], "change_id string, cohort_idx int")
    deps = spark.createDataFrame([("c", 1, 0), ("c", 2, 1), ("c", 3, 0), ("c", 4, 3), ("c", 4, 2), ("c", 2, 3)], "change_id string, cohort_idx int, dep_idx int")
    got = {r.cohort_idx: (r.depth, r.connected) for r in G.flow_depth(cohorts, deps).collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (2, True), 3: (1, True), 4: (3, True), 5: (0, False)}


def test_plan_cohorts_splits_large_directories(spark):
    paths = [f"src/a/f{i}.go" for i in range(5)] + ["src/b/x.go", "src/top.go"] + ["readme.md", "one.md"]
    files = spark.createDataFrame([("c", i, p) for i, p in enumerate(paths)], "change_id string, file_idx int, path string")
    whole = [sorted(map(tuple, W.plan_cohorts(files, 3, bounded).collect())) for bounded in (True, False)]
    assert whole[0] == whole[1]
    rows = W.plan_cohorts(files, 3).groupBy("cohort_idx", "title").agg(F.count("*").alias("n")).orderBy("cohort_idx").collect()
    assert [(r.title, r.n) for r in rows] == [
        ("Root docs changes", 2), ("src/a backend changes (1/2)", 3), ("src/a backend changes (2/2)", 2),
        ("src/b backend changes", 1), ("src backend changes", 1),
    ]


def test_long_lists_of_previews_and_cohorts(spark):
    import random

    from changeloom.settings import Settings

    rng = random.Random(3)
    sizes = [(rng.randint(1, 40), rng.randint(1, 40)) for _ in range(1_500)]
    frame = spark.createDataFrame([("c", k, f"{k}.png", *s) for k, s in enumerate(sizes)], "change_id string, file_idx int, path string, old_size int, new_size int")
    left, taken = 30_000, []
    for k, pair in enumerate(sizes):
        for side, size in enumerate(pair):
            if size <= left:
                left -= size
                taken.append((k, side))
    got = P.preview_budget(frame, Settings(max_preview_bytes=100, max_total_preview_bytes=30_000)).collect()
    assert sorted((r.file_idx, r.side) for r in got) == taken and len(taken) > 1_000
    told = spark.createDataFrame(
        [("c", k, "api", f"title {k}", "why", "story " * 30, None, 1) for k in range(900)],
        "change_id string, cohort_idx int, layer string, title string, intent string, narrative string, review_notes array<string>, files int",
    )
    changes = spark.createDataFrame([("c", "t", "d")], "change_id string, title string, description string")
    text = P.fair_share(changes, told, 10_000_000, Settings(digest_max_chars=10_000_000)).first().text
    lines = text.splitlines()[3:]
    assert len(lines) == 900 and all(f"title=title {k} " in line and line.endswith("f=1") for k, line in enumerate(lines))
