"""Dependency graphs of a change: order, components, cohort dependencies, depth.

Topological order with ties by position is sequential inside connected files, so that step
runs in Python on integer triples, per change, and only for files that have an edge. All
other files are placed by the final sort, in Spark.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.operators.aggregate import cohort_weights
from changeloom.operators.ranking import rank_rows
from changeloom.settings import DEFAULTS, Settings
from changeloom.sources.shared import materialize, shared_folder

PARTS_PER_CALL = 256


def components(nodes: list[int], targets: dict[int, list[int]]) -> dict[int, int]:
    """Component label (its smallest node) per node, by two depth-first passes."""
    finished: list[int] = []
    seen: set[int] = set()
    sources: dict[int, list[int]] = {}
    for node, outs in targets.items():
        for out in outs:
            sources.setdefault(out, []).append(node)
    for root in nodes:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(targets.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            following = next((n for n in rest if n not in seen), None)
            if following is None:
                finished.append(node)
                stack.pop()
            else:
                seen.add(following)
                stack.append((following, iter(targets.get(following, ()))))
    label: dict[int, int] = {}
    for root in reversed(finished):
        if root in label:
            continue
        members, stack = [], [root]
        label[root] = root
        while stack:
            node = stack.pop()
            members.append(node)
            for before in sources.get(node, ()):
                if before not in label:
                    label[before] = root
                    stack.append(before)
        smallest = min(members)
        for member in members:
            label[member] = smallest
    return label


def without_lone_insiders(edges: set[tuple[int, int]], hubs: list[tuple[set[int], set[int]]]) -> tuple[set[tuple[int, int]], list]:
    """Hubs where no importer is the only one among the hub's own files.

    Such an importer would close a cycle with itself through the hub; it gets plain edges. Two or
    more of them import each other anyway.
    """
    edges, kept = set(edges), []
    for importers, members in hubs:
        inside = importers & members
        if len(inside) == 1:
            (lone,) = inside
            edges |= {(lone, member) for member in members if member != lone}
            importers = importers - inside
        kept.append((importers, members))
    return edges, kept


def dependency_order(nodes: list[int], edges: set[tuple[int, int]], hubs: list[tuple[set[int], set[int]]] = ()) -> list[int]:
    """Dependencies first, ties by number; a cycle keeps the current order of its members.

    ``nodes`` are positions, ``edges`` (importer, imported) pairs of positions, and of each of
    ``hubs`` every importer imports every member. When chains and edges block each other, the
    current order stays.
    """
    nodes = sorted(nodes)
    edges, hubs = without_lone_insiders(edges, hubs)
    targets: dict[int, list[int]] = {}
    for importer, imported in edges:
        targets.setdefault(importer, []).append(imported)
    marks = [-1 - k for k in range(len(hubs))]
    for mark, (importers, members) in zip(marks, hubs, strict=True):
        targets[mark] = list(members)
        for importer in importers:
            targets.setdefault(importer, []).append(mark)
    label = components([*nodes, *marks], targets)
    waits = {(a, b) for a, b in edges if label[a] != label[b]}
    gates = []
    for mark, (importers, members) in zip(marks, hubs, strict=True):
        # Importers in a cycle with the hub wait for the members outside that cycle, the others for all.
        outer = {i for i in importers if label[i] != label[mark]}
        for waiting, awaited in ((outer, members), (importers - outer, {m for m in members if label[m] != label[mark]})):
            gate = -1 - len(gates)  # gates are taken before any position, as soon as they are free
            gates.append(gate)
            waits |= {(i, gate) for i in waiting} | {(gate, m) for m in awaited}
    last: dict[int, int] = {}
    for node in nodes:
        if label[node] in last:
            waits.add((node, last[label[node]]))
        last[label[node]] = node
    missing = dict.fromkeys([*nodes, *gates], 0)
    dependents: dict[int, list[int]] = {}
    for later, earlier in waits:
        missing[later] += 1
        dependents.setdefault(earlier, []).append(later)
    ready = [node for node, count in missing.items() if count == 0]
    heapq.heapify(ready)
    placed: list[int] = []
    while ready:
        node = heapq.heappop(ready)
        if node >= 0:
            placed.append(node)
        for later in dependents.get(node, ()):
            missing[later] -= 1
            if missing[later] == 0:
                heapq.heappush(ready, later)
    return placed if len(placed) == len(nodes) else nodes


def order_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Order the linked positions of some parts of one change, and how far each one is held back."""
    ends: dict[int, list] = {}
    for part, *end in zip(rows["part"].tolist(), rows["importer_pos"].tolist(), rows["imported_pos"].tolist(), rows["node"].tolist(), strict=True):
        ends.setdefault(part, []).append(end)
    ordered = [(part, *placed) for part, links in ends.items() for placed in order_part(links)]
    found = pd.DataFrame(ordered, columns=["part", "pos", "held", "turn"])
    found.insert(0, "change_id", rows["change_id"].iloc[0])
    return found


def order_part(ends: list) -> list[tuple[int, int, int]]:
    """(pos, held, turn) of the linked positions of one part."""
    pairs, hubs = set(), {}
    for importer, imported, node in ends:
        if node is None:
            pairs.add((importer, imported))
        else:
            sides = hubs.setdefault(node, (set(), set()))
            sides[importer < 0].add(max(importer, imported))
    nodes = {end for pair in pairs for end in pair}.union(*[side for sides in hubs.values() for side in sides])
    placed = dependency_order(list(nodes), pairs, list(hubs.values()))
    held, top = [], -1
    for node in placed:
        top = max(top, node)
        held.append(top)
    return list(zip(placed, held, range(len(placed)), strict=True))


def stable_order(
    items: DataFrame, edges: DataFrame, bounded: bool = True, links: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(change_id, part, file_idx, pos, new_pos): dependencies first inside each part.

    ``items`` is (change_id, part, file_idx, pos); a part is a cohort, or one constant for a
    whole change. ``links`` are package imports (``directory_links``), which are read without
    expanding them to edges. Merging an ordered sequence with independent files, smallest position
    first, equals sorting by the largest position so far in the sequence. So only files with
    an edge inside their part go to Python, and one sort places everything.
    """
    where = items.select("change_id", "part", "file_idx", "pos")

    def end(name: str) -> DataFrame:
        return where.select(
            "change_id", F.col("part").alias(f"{name}_part"), F.col("file_idx").alias(name),
            F.col("pos").alias(f"{name}_pos"),
        )

    internal = (
        edges.select("change_id", "importer", "imported").distinct()
        .join(end("importer"), ["change_id", "importer"]).join(end("imported"), ["change_id", "imported"])
        .where("importer_part = imported_part AND importer <> imported")
        .select("change_id", F.col("importer_part").alias("part"), "importer_pos", "imported_pos", F.lit(None).cast("string").alias("node"))
    )
    if links:
        none, key = F.lit(-1), ["change_id", "part", "node"]
        asks = links[0].join(end("importer"), ["change_id", "importer"]).select(
            "change_id", F.col("importer_part").alias("part"), "importer_pos", none.alias("imported_pos"), "node"
        )
        members = links[1].join(end("imported"), ["change_id", "imported"]).select(
            "change_id", F.col("imported_part").alias("part"), none.alias("importer_pos"), "imported_pos", "node"
        )
        members = members.join(asks, key, "left_semi")
        internal = internal.unionByName(asks.join(members, key, "left_semi")).unionByName(members)
    fields = {f.name: f.dataType.simpleString() for f in where.schema.fields}
    # Small parts go to Python together: a call for each of a million parts costs more than their order.
    placed = internal.groupBy("change_id", F.floor(F.col("part") / PARTS_PER_CALL)).applyInPandas(
        order_group,
        f"change_id {fields['change_id']}, part {fields['part']}, pos int, held int, turn int",
    )
    joined = where.join(placed, ["change_id", "part", "pos"], "left").select(
        "change_id", "part", "file_idx", "pos",
        F.coalesce("held", "pos").alias("held"), F.coalesce("turn", F.lit(0)).alias("turn"),
    )
    return rank_rows(joined, ["change_id", "part"], ["held", "turn"], "new_pos", bounded=bounded).drop("held", "turn")


def component_group(edges: pd.DataFrame) -> pd.DataFrame:
    targets: dict[int, list[int]] = {}
    for importer, imported in zip(edges["importer"].tolist(), edges["imported"].tolist(), strict=True):
        targets.setdefault(importer, []).append(imported)
    nodes = sorted(set(edges["importer"].tolist()) | set(edges["imported"].tolist()))
    label = components(nodes, targets)
    return pd.DataFrame(
        {"change_id": edges["change_id"].iloc[0], "node": nodes, "component": [label[n] for n in nodes]}
    )


def scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(change_id, node, component, size): strongly connected components of each change.

    A component is named by its smallest node. Nodes without edges never reach Python.
    """
    linked = edges.groupBy("change_id").applyInPandas(
        component_group, "change_id string, node int, component int"
    )
    labelled = nodes.join(linked, ["change_id", "node"], "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    sizes = labelled.groupBy("change_id", "component").agg(F.count("*").cast("int").alias("size"))
    return labelled.join(sizes, ["change_id", "component"]).select("change_id", "node", "component", "size")


def reachable_labels(edges: DataFrame, labels: DataFrame, source: str, target: str) -> DataFrame:
    """Smallest label that reaches each node along the edges, by repeated joins.

    Every round is one equi join and one combining aggregation; lineage is cut with a
    reliable checkpoint, so a lost executor repeats one round only.
    """
    while True:
        pushed = side_by_side(edges, labels.withColumnRenamed("node", source), source).select(
            F.col(target).alias("node"), "label"
        )
        merged = labels.unionByName(pushed).groupBy("node").agg(F.min("label").alias("label")).checkpoint()
        changed = side_by_side(merged, labels.withColumnRenamed("label", "old"), "node").where("label <> old")
        if changed.isEmpty():
            return merged
        labels = merged


def side_by_side(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two tables of numbers that grow with the corpus: both are dealt by key.

    Their files are far smaller than their rows, so a size taken from the files would send
    millions of rows through the driver, in every round again.
    """
    return left.join(right.hint("merge"), on, how)


def contract(links: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of shrinking a graph (src, dst): the nodes that leave it, and what is left.

    A node without edges of one direction is a component of its own. A node with one edge in, or
    one out, shares a component with the node at its other end or with none; its remaining edges are
    drawn from or to that node instead. Nodes that leave together are never neighbours. Returns
    (node) of the first kind, (node, keeper, other) of the second with the far ends of its remaining
    edges, and the new links.
    """
    outward = links.select(F.col("src").alias("node"), F.col("dst").alias("out"), F.lit(None).cast("long").alias("in"))
    inward = links.select(F.col("dst").alias("node"), F.lit(None).cast("long").alias("out"), F.col("src").alias("in"))
    degrees = outward.unionByName(inward).groupBy("node").agg(
        F.count("in").alias("n_in"), F.min("in").alias("one_in"), F.count("out").alias("n_out"), F.min("out").alias("one_out")
    )
    kind = F.when((F.col("n_in") == 0) | (F.col("n_out") == 0), "dead").when(F.col("n_in") == 1, "in").when(F.col("n_out") == 1, "out")
    keeper = F.when(F.col("n_in") == 1, F.col("one_in")).otherwise(F.col("one_out"))
    marked = materialize(
        degrees.withColumn("kind", kind).where("kind IS NOT NULL")
        .select("node", "kind", keeper.alias("keeper"), F.xxhash64("node", F.lit(turn)).alias("order")), "marked-nodes",
    )
    dead = marked.where("kind = 'dead'").select("node")
    side = lambda name: marked.select(F.col("node").alias(name), F.col("order").alias(f"{name}_order"), F.col("kind").alias(f"{name}_kind"))
    near = side_by_side(side_by_side(links, side("src"), "src"), side("dst"), "dst")
    # Of two marked neighbours one stays: not a dead one, and of others the one with the smaller order.
    loses = (F.col("src_kind") != "dead") & ((F.col("dst_kind") == "dead") | (F.col("src_order") < F.col("dst_order")))
    kept = near.select(F.when(loses, F.col("src")).when(F.col("dst_kind") != "dead", F.col("dst")).alias("node")).distinct()
    chosen = materialize(side_by_side(marked.where("kind <> 'dead'"), kept, "node", "left_anti").select("node", "kind", "keeper"), "leaving-nodes")
    end = lambda name: chosen.unionByName(dead.select("node", F.lit("dead").alias("kind"), F.lit(None).cast("long").alias("keeper"))).select(
        F.col("node").alias(name), F.col("kind").alias(f"{name}_kind"), F.col("keeper").alias(f"{name}_keeper")
    )
    both = materialize(side_by_side(side_by_side(links, end("src"), "src", "left"), end("dst"), "dst", "left"), "marked-links")
    gone = both.where("src_kind = 'in'").select(F.col("src").alias("node"), F.col("src_keeper").alias("keeper"), F.col("dst").alias("other")).unionByName(
        both.where("dst_kind = 'out'").select(F.col("dst").alias("node"), F.col("dst_keeper").alias("keeper"), F.col("src").alias("other"))
    )
    left = (
        both.where("coalesce(src_kind, '') NOT IN ('dead', 'out') AND coalesce(dst_kind, '') NOT IN ('dead', 'in')")
        .select(F.coalesce("src_keeper", "src").alias("src"), F.coalesce("dst_keeper", "dst").alias("dst"))
        .where("src <> dst").distinct()
    )
    return dead, gone, materialize(left, "links")


def component_of_all(edges: pd.DataFrame) -> pd.DataFrame:
    targets: dict[int, list[int]] = {}
    for src, dst in zip(edges["src"].tolist(), edges["dst"].tolist(), strict=True):
        targets.setdefault(src, []).append(dst)
    nodes = sorted(set(edges["src"].tolist()) | set(edges["dst"].tolist()))
    label = components(nodes, targets)
    return pd.DataFrame({"node": nodes, "component": [label[n] for n in nodes]})


def scc_distributed(nodes: DataFrame, edges: DataFrame, small: int = 200_000) -> DataFrame:
    """(node, component) of one graph that spans the whole corpus, named by the smallest node.

    The graph shrinks in rounds, so chains vanish in rounds by the logarithm of their length. When at
    most ``small`` links are left, one task closes them; when a round removes too little, colours
    spread over the rest. Then the nodes that left come back, last ones first: such a node belongs
    to its keeper's component when one of its other neighbours does.
    """
    links = materialize(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct(), "links")
    count, rounds, alone = links.count(), [], []
    while count > small:
        dead, gone, left = contract(links, len(rounds))
        before, count = count, left.count()
        alone.append(dead)
        rounds.append(gone)
        links = left
        if count > 0.95 * before:
            break
    if count <= small:
        known = links.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(component_of_all, "node long, component long")
    else:
        ends = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
        known = coloured_components(ends, links)
    for dead in alone:
        known = known.unionByName(dead.select("node", F.col("node").alias("component")))
    known = materialize(known, "components")
    for gone in reversed(rounds):
        label = lambda name: known.select(F.col("node").alias(name), F.col("component").alias(f"{name}_component"))
        # A keeper or neighbour that is nowhere is left without links: it stands alone.
        judged = side_by_side(side_by_side(gone, label("keeper"), "keeper", "left"), label("other"), "other", "left").select(
            "node", F.coalesce("keeper_component", "keeper").alias("kept"), F.coalesce("other_component", "other").alias("met")
        )
        back = judged.groupBy("node").agg(F.max(F.col("kept") == F.col("met")).alias("inside"), F.min("kept").alias("kept"))
        added = back.select("node", F.when(F.col("inside"), F.col("kept")).otherwise(F.col("node")).alias("component"))
        known = materialize(known.unionByName(added), "components")
    # Nodes that lost all their links are in no table; a component is named by its smallest node.
    every = side_by_side(nodes.select(F.col("node").cast("long").alias("node")).distinct(), known, "node", "left").select("node", F.coalesce("component", "node").alias("mark"))
    names = every.groupBy("mark").agg(F.min("node").alias("component"))
    return side_by_side(every, names, "mark").select("node", "component")


def coloured_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) by colours, for graphs whose nodes all have several edges.

    Each round names every node by the smallest node that reaches it; the nodes which that
    node also is reached from form its component and leave the graph. Rounds go on until no
    edge is left between unplaced nodes, whose ends then stand alone.
    """
    shared_folder(nodes.sparkSession)
    left = nodes.select("node").distinct()
    links = edges.select("src", "dst").where("src <> dst").distinct()
    done = None
    while not links.isEmpty():
        start = left.withColumn("label", F.col("node"))
        forward = reachable_labels(links, start, "src", "dst")
        named = forward.withColumnRenamed("label", "color")
        # Backwards only inside one colour: the pivot's component is what reaches it there.
        inner = (
            side_by_side(side_by_side(links, named.selectExpr("node AS src", "color AS sc"), "src"), named.selectExpr("node AS dst", "color AS dc"), "dst")
            .where("sc = dc").select("src", "dst")
        )
        pivots = named.where("node = color").select("node", F.col("color").alias("label"))
        others = named.where("node <> color").select("node", F.lit(None).cast("bigint").alias("label"))
        backward = spread_back(inner, pivots.unionByName(others))
        found = backward.where("label IS NOT NULL").select("node", F.col("label").alias("component")).checkpoint()
        done = found if done is None else done.unionByName(found)
        left = side_by_side(left, found, "node", "left_anti").checkpoint()
        links = (
            side_by_side(side_by_side(links, left.withColumnRenamed("node", "src"), "src", "left_semi"), left.withColumnRenamed("node", "dst"), "dst", "left_semi")
            .checkpoint()
        )
    alone = left.select("node", F.col("node").alias("component"))
    return alone if done is None else done.unionByName(alone)


def spread_back(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Carry labels from edge targets to their sources until nothing changes."""
    while True:
        pushed = side_by_side(edges, labels.where("label IS NOT NULL").withColumnRenamed("node", "dst"), "dst").select(
            F.col("src").alias("node"), "label"
        )
        merged = labels.unionByName(pushed).groupBy("node").agg(F.min("label").alias("label")).checkpoint()
        if side_by_side(merged, labels.withColumnRenamed("label", "old"), "node").where("label IS NOT NULL AND old IS NULL").isEmpty():
            return merged
        labels = merged


def cohort_edge_join(edges: DataFrame, cohort_files: DataFrame) -> DataFrame:
    """Distinct file edges with the cohorts of both ends."""
    where = cohort_files.select("change_id", "cohort_idx", "file_idx")

    def end(file_column: str, cohort_column: str) -> DataFrame:
        return where.select(
            "change_id", F.col("file_idx").alias(file_column), F.col("cohort_idx").alias(cohort_column)
        )

    return (
        edges.select("change_id", "importer", "imported").distinct()
        .join(end("importer", "dependent"), ["change_id", "importer"])
        .join(end("imported", "dependency"), ["change_id", "imported"])
    )


def linked_weights(edges: DataFrame, links: tuple[DataFrame, DataFrame], cohort_files: DataFrame) -> DataFrame:
    """``cohort_weights`` of the edges and package imports together, from counts per node.

    Importers of one cohort times files of another are the edges of a node; a file that imports
    its own directory is no edge, and an edge that a node holds counts once.
    """
    asks, members = links
    place = lambda name, cohort: cohort_files.select("change_id", F.col("file_idx").alias(name), F.col("cohort_idx").alias(cohort))
    pair = ["change_id", "dependent", "dependency"]
    asked = asks.join(place("importer", "dependent"), ["change_id", "importer"]).groupBy("change_id", "node", "dependent").agg(F.count("*").alias("n"))
    held = members.join(place("imported", "dependency"), ["change_id", "imported"]).groupBy("change_id", "node", "dependency").agg(F.count("*").alias("m"))
    products = asked.join(held, ["change_id", "node"]).select(*pair, (F.col("n") * F.col("m")).alias("weight"))
    selves = asks.join(members.withColumnRenamed("imported", "importer"), ["change_id", "node", "importer"]).join(
        place("importer", "dependent"), ["change_id", "importer"]
    ).select("change_id", "dependent", F.col("dependent").alias("dependency"), F.lit(-1).cast("bigint").alias("weight"))
    single = edges.select("change_id", "importer", "imported").distinct()
    covered = single.join(asks, ["change_id", "importer"]).join(members, ["change_id", "node", "imported"], "left_semi").select(single.columns)
    others = cohort_edge_join(single.join(covered, single.columns, "left_anti"), cohort_files).select(*pair, F.lit(1).cast("bigint").alias("weight"))
    return (
        products.unionByName(selves).unionByName(others).groupBy(*pair).agg(F.sum("weight").alias("weight")).where("weight > 0")
    )


def top3_deps(weights: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Strongest dependencies per cohort: weight first, then the earlier cohort."""
    order = Window.partitionBy("change_id", "dependent").orderBy(F.desc("weight"), "dependency")
    return weights.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= settings.max_cohort_dependencies
    ).select("change_id", F.col("dependent").alias("cohort_idx"), "rank", F.col("dependency").alias("dep_idx"))


def weights_of(edges: DataFrame, cohort_files: DataFrame, links: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Number of file edges per pair of cohorts, package imports included if they are given."""
    return linked_weights(edges, links, cohort_files) if links else cohort_weights(cohort_edge_join(edges, cohort_files))


def cohort_deps(
    edges: DataFrame, cohort_files: DataFrame, settings: Settings = DEFAULTS, links: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Dependencies on earlier cohorts only, the three strongest."""
    return top3_deps(weights_of(edges, cohort_files, links).where("dependency < dependent"), settings)


def reorder_cohort_files(
    cohort_files: DataFrame, edges: DataFrame, links: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Files of each cohort in reading order; other columns (summaries) travel along."""
    items = cohort_files.select("change_id", F.col("cohort_idx").alias("part"), "file_idx", "pos")
    ordered = stable_order(items, edges, links=links).select(
        "change_id", F.col("part").alias("cohort_idx"), "file_idx", "new_pos"
    )
    return cohort_files.join(ordered, ["change_id", "cohort_idx", "file_idx"]).drop("pos").withColumnRenamed(
        "new_pos", "pos"
    )


def stable_cohort_order(
    edges: DataFrame, cohort_files: DataFrame, settings: Settings = DEFAULTS, links: tuple[DataFrame, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(change_id, cohort_idx, new_idx), and the dependencies by new index.

    Cohorts are ordered by their summed edges; edges inside a cycle of cohorts order
    nothing and are no dependencies.
    """
    # Small tables of numbers which the steps below read several times.
    weights = materialize(weights_of(edges, cohort_files, links).where("dependent <> dependency"), "cohort-weights")
    cohorts = cohort_files.select("change_id", "cohort_idx").distinct()
    items = cohorts.select(
        "change_id", F.lit(0).alias("part"), F.col("cohort_idx").alias("file_idx"), F.col("cohort_idx").alias("pos")
    )
    pairs = weights.select("change_id", F.col("dependent").alias("importer"), F.col("dependency").alias("imported"))
    placed = stable_order(items, pairs).select(
        "change_id", F.col("file_idx").alias("cohort_idx"), F.col("new_pos").alias("new_idx")
    )
    label = scc(cohorts.withColumnRenamed("cohort_idx", "node"), pairs).select(
        "change_id", F.col("node").alias("cohort_idx"), "component"
    )
    placed = materialize(placed.join(label, ["change_id", "cohort_idx"]), "cohort-order")

    def side(name: str) -> DataFrame:
        return placed.select(
            "change_id", F.col("cohort_idx").alias(name), F.col("new_idx").alias(f"new_{name}"),
            F.col("component").alias(f"{name}_component"),
        )

    renamed = (
        weights.join(side("dependent"), ["change_id", "dependent"]).join(side("dependency"), ["change_id", "dependency"])
        .where("dependent_component <> dependency_component")
        .select("change_id", F.col("new_dependent").alias("dependent"), F.col("new_dependency").alias("dependency"), "weight")
    )
    return placed.drop("component"), top3_deps(renamed, settings)


def depth_group(deps: pd.DataFrame) -> pd.DataFrame:
    """Depth of the cohorts of one change which have or are a dependency."""
    depth: dict[int, int] = {}
    pairs = sorted(zip(deps["cohort_idx"].tolist(), deps["dep_idx"].tolist(), strict=True))
    for cohort, below in pairs:
        depth[cohort] = max(depth.get(cohort, 0), depth.setdefault(below, 0) + 1)
    return pd.DataFrame(
        {"change_id": deps["change_id"].iloc[0], "cohort_idx": list(depth), "depth": list(depth.values())}
    )


def flow_depth(cohorts: DataFrame, deps: DataFrame) -> DataFrame:
    """(change_id, cohort_idx, depth, connected): longest chain of dependencies below a cohort.

    Dependencies point to earlier cohorts, so one pass in cohort order is enough. Only the
    dependency pairs go to Python; cohorts without any have depth 0.
    """
    earlier = deps.where("dep_idx >= 0 AND dep_idx < cohort_idx").select("change_id", "cohort_idx", "dep_idx")
    linked = earlier.groupBy("change_id").applyInPandas(
        depth_group, "change_id string, cohort_idx int, depth int"
    )
    return cohorts.select("change_id", "cohort_idx").distinct().join(
        linked, ["change_id", "cohort_idx"], "left"
    ).select(
        "change_id", "cohort_idx", F.coalesce("depth", F.lit(0)).alias("depth"),
        F.col("depth").isNotNull().alias("connected"),
    )
