"""Hard negatives by spanning trees of anchors.

Anchors of a block are joined by a minimum spanning tree. A candidate's score with the root is
computed; with every other anchor it lies within the parent's score plus or minus the edge's
length times the candidate's norm. Only pairs whose interval meets the anchor's window are scored
again. The window's lower end rises while better rows are found, so later candidates need less.

Two passes use the same walk: the best rows of the anchor's label give its positives; then the
best rows of other labels between two shares of a positive's score are its negatives. Blocks of
anchors and of rows meet as cells of a grid, one cell at a time in a task; each cell sends its few
best rows per anchor, and a window over those gives the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.worker import stream
from changeloom.sources.shared import materialize

SCALE = 256
BLOCK_ANCHORS, BLOCK_ROWS, MOST_BLOCKS = 1_024, 16_384, 512
TILE = 2_048
SAFE = float(1 << 53)
LARGEST = (1 << 63) - 1
FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def vectors(column: pa.Array, width: int = 0) -> np.ndarray:
    """Components times 256, rounded down; shorter vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    size = np.diff(offsets)
    width = max(width, int(size.max(initial=0)))
    if len(size) and (size == width).all():
        return flat[offsets[0]:offsets[-1]].reshape(len(size), width)
    out = np.zeros((len(size), width))
    for k, (a, n) in enumerate(zip(offsets.tolist(), size.tolist())):
        out[k, :n] = flat[a:a + n]
    return out


def widened(table: np.ndarray, width: int) -> np.ndarray:
    return table if table.shape[1] == width else np.pad(table, ((0, 0), (0, width - table.shape[1])))


def whole(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows in unbounded integers, held at the ends of 64 bits."""
    a = np.array([[int(x) for x in row] for row in left], object).reshape(left.shape)
    b = np.array([[int(x) for x in row] for row in right], object).reshape(right.shape)
    return np.clip(a @ b.T, -LARGEST - 1, LARGEST) if left.shape[1] else np.zeros((len(a), len(b)), object)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, parents (places in that order, -1 for the root) and edge lengths of a minimum spanning
    tree; the root is the point with the least distances to all, parents come before children."""
    n = len(points)
    norms = (points * points).sum(1)
    squares = np.maximum(norms[:, None] + norms[None, :] - 2 * points @ points.T, 0)
    root = int(np.sqrt(squares).sum(1).argmin()) if n else 0
    near, parent, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    near[root] = 0
    depth = np.zeros(n, int)
    for _ in range(n):
        k = int(np.where(done, np.inf, near).argmin())
        done[k] = True
        depth[k] = depth[parent[k]] + 1 if parent[k] >= 0 else 0
        closer = ~done & (squares[k] < near)
        near[closer], parent[closer] = squares[k][closer], k
    order = np.argsort(depth, kind="stable")
    place = np.empty(n, int)
    place[order] = np.arange(n)
    edges = np.where(parent[order] >= 0, np.sqrt(((points[order] - points[np.maximum(parent[order], 0)]) ** 2).sum(1)), 0.0)
    return order, np.where(parent[order] >= 0, place[np.maximum(parent[order], 0)], -1), edges


class Walk:
    """One block of anchors: their tree, and what each has found so far."""

    def __init__(self, anchors: dict[str, np.ndarray]):
        points = anchors["vector"]
        order, self.parent, self.edge = spanning_tree(points)
        self.points = points[order]
        self.ids, self.labels = anchors["id"][order], anchors["label"][order]
        self.order = order
        level = np.zeros(len(order), int)
        for k, p in enumerate(self.parent.tolist()):
            level[k] = level[p] + 1 if p >= 0 else 0
        self.levels = np.split(np.arange(len(order)), np.flatnonzero(np.diff(level)) + 1) if len(order) else []
        self.largest = np.abs(self.points).max(initial=0)
        self.scored = self.pairs = 0

    def near(self, rows: dict[str, np.ndarray], same: bool, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs of one label, or of two, with scores in the anchors' windows."""
        tile = rows["vector"]
        wanted = (self.labels[:, None] == rows["label"]) == same
        width = max(tile.shape[1], self.points.shape[1])
        points, tile = widened(self.points, width), widened(tile, width)
        self.pairs += len(points) * len(tile)
        if self.largest * np.abs(tile).max(initial=0) * width >= SAFE:  # beyond exact doubles
            scores = whole(points, tile)
            low, high = np.nextafter(low, -np.inf), np.nextafter(high, np.inf)
            a, b = np.nonzero(wanted & (scores >= low[:, None]) & (scores <= high[:, None]))
            self.scored += len(points) * len(tile)
            return a, b, scores[a, b].astype(np.int64)
        norms = np.sqrt((tile * tile).sum(1))
        least, most = np.empty((len(points), len(tile))), np.empty((len(points), len(tile)))
        found = []
        for level in self.levels:
            if self.parent[level[0]] < 0:
                open_ = np.ones((1, len(tile)), bool)
            else:
                reach = self.edge[level, None] * norms * (1 + 1e-9) + 1
                parent = self.parent[level]
                least[level], most[level] = least[parent] - reach, most[parent] + reach
                open_ = wanted[level] & (most[level] >= low[level, None]) & (least[level] <= high[level, None])
            full = open_.mean(1) > 0.1
            if full.any():  # most of a row: one product for it
                at = level[full]
                least[at] = most[at] = points[at] @ tile.T
                self.scored += len(at) * len(tile)
                a, b = np.nonzero(wanted[at] & (least[at] >= low[at, None]) & (least[at] <= high[at, None]))
                found.append((at[a], b, least[at[a], b]))
            a, b = np.nonzero(open_ & ~full[:, None])
            if len(a):
                a = level[a]
                scores = np.einsum("ij,ij->i", points[a], tile[b])
                least[a, b] = most[a, b] = scores
                self.scored += len(a)
                inside = (scores >= low[a]) & (scores <= high[a])
                found.append((a[inside], b[inside], scores[inside]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


class Best:
    """The first rows of every place: highest score, then smallest id."""

    def __init__(self, places: int, most: int):
        self.places, self.most = places, most
        self.kept = tuple(np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(places, -np.inf)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        place, score, ids = (np.concatenate(x) for x in zip(self.kept, (place, score, ids)))
        order = np.lexsort((ids, ~score, place))
        place, score, ids = place[order], score[order], ids[order]
        begin = np.searchsorted(place, np.arange(self.places + 1))
        keep = np.arange(len(place)) - begin[place] < self.most
        self.kept = place[keep], score[keep], ids[keep]
        count = np.diff(begin)
        full = np.flatnonzero(count >= self.most)
        self.least[full] = score[begin[full] + self.most - 1]


def positives_of(anchors: dict[str, np.ndarray], most: int, share: tuple[int, int]) -> tuple[Callable, Callable]:
    walk = Walk(anchors)
    best = Best(len(walk.ids), most)

    def add(tile: dict[str, np.ndarray]) -> None:
        a, b, score = walk.near(tile, True, best.least, np.full(len(best.least), np.inf))
        ids = tile["id"][b]
        other = ids != walk.ids[a]
        best.add(a[other], score[other], ids[other])

    def result() -> Iterator[pa.RecordBatch]:
        place, score, ids = best.kept
        yield found_batch(walk.ids[place], ids, score, ids, score)

    return add, result


def negatives_of(anchors: dict[str, np.ndarray], most: int, share: tuple[int, int]) -> tuple[Callable, Callable]:
    walk = Walk(anchors)
    # One place per anchor and positive; bounds of the scores between the shares, in integers.
    pairs = [anchors["positives"][k] for k in walk.order.tolist()]
    owner = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
    positive = np.array([p for x in pairs for p, _ in x], np.int64)
    reference = np.array([s for x in pairs for _, s in x], object)
    low = np.array([-(-share[0] * s // 100) for s in reference], np.float64)
    high = np.array([share[1] * s // 100 for s in reference], np.float64)
    exact_low = np.array([max(-(-share[0] * s // 100), -LARGEST - 1) for s in reference], np.int64)
    exact_high = np.array([min(share[1] * s // 100, LARGEST) for s in reference], np.int64)
    best = Best(len(owner), most)
    begin = np.searchsorted(owner, np.arange(len(pairs) + 1))

    def add(tile: dict[str, np.ndarray]) -> None:
        now = np.maximum(low, best.least)
        ends = np.full(len(pairs), np.inf), np.full(len(pairs), -np.inf)
        np.minimum.at(ends[0], owner, now)
        np.maximum.at(ends[1], owner, high)
        a, b, score = walk.near(tile, False, *ends)
        for k in range(int(np.diff(begin).max(initial=0))):  # the k-th positive of every anchor
            has = begin[a] + k < begin[a + 1]
            place = begin[a[has]] + k
            inside = (score[has] >= exact_low[place]) & (score[has] <= exact_high[place])
            inside &= score[has] >= best.least[place]
            best.add(place[inside], score[has][inside], tile["id"][b[has][inside]])

    def result() -> Iterator[pa.RecordBatch]:
        place, score, ids = best.kept
        yield found_batch(walk.ids[owner[place]], positive[place], reference[place].astype(np.int64), ids, score)

    return add, result


def found_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in FOUND.split(", ")])


def meet(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int, start: Callable, most: int, share: tuple[int, int] = (0, 0)) -> DataFrame:
    """What every cell of the grid finds: each block of anchors with each part of the rows."""
    none = F.lit(None).cast("array<struct<id:long,score:long>>")
    kind = rows.schema["vector"].dataType
    side = lambda frame, own: frame.select("id", "label", "vector", *own)
    left = side(anchors, ["positives", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("side")])
    right = side(rows, [none.alias("positives"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("side")])
    left = left.withColumn("vector", F.col("vector").cast(kind))

    def run(batches: Iterator[pa.RecordBatch]):
        cell, held, add, result = None, [], None, None
        for batch in batches:
            at = 0
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "side")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for end in [*cuts.tolist(), batch.num_rows]:
                key, part = tuple(keys[:2, at].tolist()), batch.slice(at, end - at)
                if key != cell:
                    if add:
                        yield from result()
                    cell, held, add = key, [], None
                if keys[2, at] == 0:
                    held.append(part)
                elif held:
                    if not add:
                        together = pa.Table.from_batches(held).combine_chunks()
                        add, result = start({
                            "id": together.column("id").to_numpy(), "label": together.column("label").to_numpy(),
                            "vector": vectors(together.column("vector")),
                            "positives": [[(p["id"], p["score"]) for p in x or []] for x in together.column("positives").to_pylist()],
                        }, most, share)
                    for low in range(0, part.num_rows, TILE):
                        tile = part.slice(low, TILE)
                        add({"id": tile.column("id").to_numpy(), "label": tile.column("label").to_numpy(), "vector": vectors(tile.column("vector"))})
                at = end
        if add:
            yield from result()

    together = left.unionByName(right).repartition("block", "part").sortWithinPartitions("block", "part", "side")
    return together.mapInArrow(run, FOUND)


def firsts(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def in_blocks(anchors: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Anchors with a block number; signs of fixed projections bring similar ones into one block."""
    blocks = max(1, -(-count // BLOCK_ANCHORS))

    def signs(batches):
        for batch in batches:
            table = vectors(batch.column("vector"))
            turn = (stream(91, 24 * table.shape[1]) >> np.uint64(11)).astype(np.float64).reshape(table.shape[1], 24) / (1 << 52) - 1
            keys = ((table @ turn > 0) @ (1 << np.arange(24))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "signs"])

    signed = anchors.mapInArrow(signs, T.StructType([*anchors.schema.fields, T.StructField("signs", T.LongType())]))
    # Ranges of the signs with about as many anchors each.
    placed = signed.repartitionByRange(blocks, "signs", "id").withColumn("block", F.spark_partition_id()).drop("signs")
    return materialize(placed, "anchors"), blocks


def mine(
    table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
    anchor_every: int = 50, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null id, label, vector or component, or with a component that is not finite, take no
    part. Of rows that repeat an id, the one with the smallest label, then vector, counts. Shorter
    vectors count as filled with zeros. Scores beyond 64 bits are held at their ends. Other columns
    are left out; an empty table, or one label only, has no rows.
    """
    number = T.ArrayType(T.DoubleType() if "double" in table.schema[vector].dataType.simpleString() else T.FloatType())
    source = table.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast(number).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    source = source.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    one = source.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    rows = materialize(one.select("id", "row.label", "row.vector"), "vectors")
    count, chosen = rows.select(F.count("*"), F.count_if(F.col("id") % anchor_every == 0)).first()
    anchors, blocks = in_blocks(rows.where(F.col("id") % anchor_every == 0), chosen)
    parts = min(max(16, -(-count // BLOCK_ROWS)), MOST_BLOCKS)
    none = F.lit(None).cast("array<struct<id:long,score:long>>")
    near = meet(anchors.withColumn("positives", none), rows, blocks, parts, positives_of, positives)
    chosen_pairs = firsts(near, ["anchor_id"], positives).groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    asked = materialize(anchors.join(chosen_pairs.withColumnRenamed("anchor_id", "id"), "id"), "anchors")
    hard = meet(asked, rows, blocks, parts, negatives_of, negatives, share)
    return firsts(hard, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def turned(table: DataFrame) -> DataFrame:
    """``embeddings`` with the labels of every seventh row moved on by one."""
    return table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
