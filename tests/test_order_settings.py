"""Order settings switched off, and package imports inside the staged plan."""

from changeloom.operators import graph as G
from changeloom.plans import flows
from changeloom.settings import Settings
from changeloom.sources import patches

FILE = """diff --git a/{path} b/{path}
--- a/{path}
+++ b/{path}
@@ -0,0 +1,1 @@
+{line}
"""


def tables(spark):
    """Cohort 0 holds files 0 and 1, cohort 1 file 2; 0 imports 1, and 0 imports the package of 2."""
    placed = spark.createDataFrame([("c", 0, 0, 0, "a"), ("c", 0, 1, 1, "a"), ("c", 1, 2, 0, "b")], "change_id string, cohort_idx int, file_idx int, pos int, title string")
    edges = spark.createDataFrame([("c", 0, 1)], "change_id string, importer int, imported int")
    links = (spark.createDataFrame([("c", "dir go b", 0)], "change_id string, node string, importer int"),
             spark.createDataFrame([("c", "dir go b", 2)], "change_id string, node string, imported int"))
    return placed, edges, links


def test_order_settings(spark):
    placed, edges, links = tables(spark)

    def run(**switches):
        files, deps = flows.in_order(placed, edges, links, Settings(**switches))
        return (sorted((r.cohort_idx, r.pos, r.file_idx) for r in files.collect()), [(r.cohort_idx, r.dep_idx) for r in deps.collect()])

    assert run() == ([(0, 0, 2), (1, 0, 1), (1, 1, 0)], [(1, 0)])
    assert run(reading_order=False) == ([(0, 0, 2), (1, 0, 0), (1, 1, 1)], [(1, 0)])
    # Without an order of cohorts only earlier ones may be depended on, and cohort 1 is a later one.
    assert run(step_order=False) == ([(0, 0, 1), (0, 1, 0), (1, 0, 2)], [])
    assert run(cohort_dependencies=False) == (run()[0], [])
    assert run(reading_order=False, step_order=False)[0] == [(0, 0, 0), (0, 1, 1), (1, 0, 2)]
    assert G.cohort_deps(edges, placed).count() == 0


def test_staged_plan_reads_package_imports(spark, tmp_path):
    parts = [("app/main.go", 'import "example.com/x/lib"'), ("lib/a.go", "package lib"), ("lib/b.go", "package lib"), ("web/x.css", "p {}")]
    (tmp_path / "change.patch").write_text("".join(FILE.format(path=p, line=text) for p, text in parts))
    t = flows.parse(patches.read_patches(spark, str(tmp_path)))
    none = spark.createDataFrame([], "change_id string, path string, attribute string, value string")
    plan = flows.staged_plan(t, none)
    paths = {r.file_idx: r.path for r in t.files.collect()}
    assert plan.edges.count() == 0
    assert [(paths[r.importer], r.node.split()[-1]) for r in plan.links[0].collect()] == [("app/main.go", "lib")]
    assert sorted(paths[r.imported] for r in plan.links[1].collect()) == ["lib/a.go", "lib/b.go"]
    read = [paths[r.file_idx] for r in plan.cohort_files.orderBy("cohort_idx", "pos").collect()]
    assert read.index("lib/a.go") < read.index("app/main.go") and read.index("lib/b.go") < read.index("app/main.go")
