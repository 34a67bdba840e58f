"""Package imports as a graph in two parts, against the expanded edges."""

import random

import pytest
from pyspark.sql import functions as F

from changeloom.operators import graph as G
from changeloom.operators import resolve as R
from changeloom.operators.aggregate import cohort_weights

EDGES = "change_id string, importer int, imported int"


def test_order_with_hubs_equals_expanded_edges():
    """Random graphs with importers inside, outside and in cycles with their directories."""
    rng = random.Random(11)
    for _ in range(4000):
        n = rng.randint(2, 10)
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(8))}
        edges = {(a, b) for a, b in edges if a != b}
        hubs = [
            (set(rng.sample(range(n), rng.randint(0, min(3, n)))), set(rng.sample(range(n), rng.randint(1, min(5, n)))))
            for _ in range(rng.randint(1, 3))
        ]
        full = edges | {(a, b) for importers, members in hubs for a in importers for b in members if a != b}
        assert G.dependency_order(list(range(n)), edges, hubs) == G.dependency_order(list(range(n)), full)


@pytest.fixture(scope="module")
def linked(spark):
    """Changes with files in directories, nodes over them, plain edges and cohorts."""
    rng = random.Random(12)
    folder = {(f"g{k}", i): rng.randrange(3) for k in range(25) for i in range(12)}
    members = [(g, f"d{d}", i) for (g, i), d in folder.items()]
    asks = sorted({(g, f"d{rng.randrange(4)}", i) for g, i in folder if rng.random() < 0.3})
    edges = [(g, i, rng.randrange(12)) for g, i in folder if rng.random() < 0.2]
    place = [(g, rng.randrange(3), i, i) for g, i in folder]
    return (
        spark.createDataFrame(edges, EDGES).where("importer <> imported"),
        (spark.createDataFrame(asks, "change_id string, node string, importer int"), spark.createDataFrame(members, "change_id string, node string, imported int")),
        spark.createDataFrame(place, "change_id string, cohort_idx int, file_idx int, pos int"),
    )


def test_order_and_weights_without_expansion(linked):
    edges, links, cohorts = linked
    full = edges.unionByName(R.expand_links(links))
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    for part in (F.lit(0), F.col("cohort_idx")):
        items = cohorts.select("change_id", part.alias("part"), "file_idx", "pos")
        assert rows(G.stable_order(items, edges, links=links)) == rows(G.stable_order(items, full))
    wanted = cohort_weights(G.cohort_edge_join(full, cohorts))
    found = G.linked_weights(edges, links, cohorts)
    assert rows(found.select(wanted.columns)) == rows(wanted) and wanted.count() > 50


def test_links_grow_with_files_not_with_pairs(spark):
    """A thousand importers of a directory of a thousand files, and nested package names."""
    files = spark.range(2000).selectExpr(
        "'c' change_id", "cast(id as int) file_idx", "if(id < 1000, concat('lib/f', id, '.go'), concat('app/g', id, '.go')) path")
    asked = spark.range(1000, 2000).selectExpr(
        "'c' change_id", "cast(id as int) importer", "'go' language", "'go' family", "'example.com/x/lib' query")
    asks, members = R.asked_members(R.directory_links(files, asked))
    assert (asks.count(), members.count()) == (1000, 1000)
    assert R.resolve_directory(files, asked).count() == 1_000_000

    paths = ["a/org/acme/A.java", "b/org/acme/B.kt", "acme/C.java", "acme/D.py"]
    few = spark.createDataFrame([("c", i, p) for i, p in enumerate(paths)], "change_id string, file_idx int, path string")
    stars = spark.createDataFrame(
        [("c", 0, "java", "jvm", "org/acme/*"), ("c", 0, "java", "jvm", "acme/*"), ("c", 2, "java", "jvm", "org/acme/*")],
        "change_id string, importer int, language string, family string, query string")
    asks, members = R.asked_members(R.directory_links(few, stars))
    assert sorted((r.node, r.importer) for r in asks.collect()) == [("end jvm acme", 0), ("end jvm org/acme", 2)]
    assert sorted((r.importer, r.imported) for r in R.resolve_directory(few, stars).collect()) == [(0, 1), (0, 2), (2, 0), (2, 1)]


def test_importers_times_files_are_neither_shuffled_nor_sorted_again(spark):
    """Terraform modules and packages: the product of a node leaves its join as it is, and no edge comes twice."""
    from changeloom.operators import terraform as TR

    files = spark.range(40).select(F.lit("c").alias("change_id"), F.col("id").cast("int").alias("file_idx"), F.format_string("net/a%d.tf", "id").alias("path"))
    fact = "change_id string, file_idx int, dir string, role string, kind string, type_name string, name string"
    rows = [("c", k, "net", "source", "module", "", name) for k in range(30) for name in ("./", "../net")]
    rows += [("c", 0, "net", "define", "variable", "", "v"), ("c", 1, "net", "refer", "variable", "", "v"), ("c", 35, "net", "refer", "variable", "", "v")]
    edges = TR.tf_edges(files, spark.createDataFrame(rows, fact))
    found = [(r.importer, r.imported) for r in edges.collect()]
    assert len(found) == len(set(found)) and set(found) == {(i, j) for i in range(30) for j in range(40) if i != j} | {(35, 0)}

    asked = spark.createDataFrame([("c", 0, "go", "go", "net", False)] * 2, "change_id string, importer int, language string, family string, query string, relative boolean")
    for result in (edges, R.resolve_directory(files, asked)):
        assert not result._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
