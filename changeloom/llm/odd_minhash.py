"""Near-duplicate documents by MinHash bands, odd sketches and an exact check.

Every document gets MinHash samples, cut into bands, and an odd sketch: the samples folded into
a bitmap of parities, whose XOR with another one tells their similarity. Documents with equal
shingle sets are one class. Classes that share a band are gathered into clusters (a class and
the least class of each of its bands, closed over bands), so no pair that can be linked is split.
A cluster is compared in pairs of blocks of bounded size: sketches rule pairs out, pairs already
connected are passed over, and the rest is confirmed on the full sets.

A pair at the threshold shares no band with a probability of at most (1 - t^rows)^bands: 2.6e-7
for 0.85 with 32 bands of 6 rows, 3e-6 for 0.8 with 32 bands of 5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.components import components
from changeloom.llm.worker import gram_hashes, lower_table, mix, row_starts, slices, space_words, span_hashes, stream, word_spans
from changeloom.sources.shared import materialize

SKETCH_BITS = 1024
BLOCK_SHINGLES = 32_000
SIGMAS = 5.0
SIGNED = "id long, n_shingles long, set_hash binary, bands array<long>, sketch binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per row; fewer words than ``n`` make one shingle, none no set."""
    data = lower_table()[data]
    starts, ends, rows = word_spans(data, offsets, space_words())
    words = span_hashes(data, starts, ends)
    bounds = row_starts(rows, len(offsets) - 1)
    grams = gram_hashes(words, n)
    sets = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= n:
            sets.append(np.unique(grams[low:high - n + 1]))
        else:
            sets.append(gram_hashes(words[low:high], high - low) if high > low else np.empty(0, np.uint64))
    return sets


def samples(shingles: np.ndarray, k: int) -> np.ndarray:
    """``k`` MinHash samples of a set."""
    factors, shifts = stream(41, k).astype(np.uint32) | np.uint32(1), stream(43, k).astype(np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 1024):
        least = np.minimum(least, (high[at:at + 1024, None] * factors + shifts).min(0))
    return least


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    rows = len(least) // bands
    table = least.astype(np.uint64).reshape(bands, rows)
    return mix((table * (stream(47, rows) | np.uint64(1))).sum(1, dtype=np.uint64) + stream(53, bands))


def odd_sketch(least: np.ndarray) -> bytes:
    """Parities of the numbers of samples that fall on each bit."""
    spots = mix(least.astype(np.uint64) + (np.arange(len(least), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(spots.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def most_differing_bits(threshold: float, k: int) -> float:
    """XOR bits up to which a pair may have the threshold's similarity, with a wide margin."""
    lowest = threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / k)
    return SKETCH_BITS / 2 * (1 - math.exp(-4 * k * (1 - lowest) / SKETCH_BITS))


def sign(documents: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Set size, set hash, band keys and odd sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                sets = shingle_sets(data, offsets, n)
                least = [samples(s, bands * rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id")[low:high], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if m is None else band_keys(m, bands).astype(np.int64) for m in least], pa.list_(pa.int64())),
                    pa.array([None if m is None else odd_sketch(m) for m in least], pa.binary()),
                ], names=["id", "n_shingles", "set_hash", "bands", "sketch"])

    return documents.mapInArrow(run, SIGNED)


class Forest:
    """Union-find over the members of one task's group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.parent[self.root(a)] = self.root(b)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def block_links(ids: list[int], sides: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray], percent: int, most_bits: float) -> list[tuple[int, int]]:
    """Links that connect what the two blocks' pairs connect; both sides equal: pairs inside."""
    sizes = np.array([len(s) for s in sets])
    forest, links = Forest(len(ids)), []
    left = np.flatnonzero(sides == sides.min())
    right = np.flatnonzero(sides == sides.max())
    same = sides.min() == sides.max()
    for k, x in enumerate(left.tolist()):
        others = right[k + 1:] if same else right
        if not len(others):
            continue
        bits = np.bitwise_count(sketches[others] ^ sketches[x]).sum(1)
        fits = (100 * np.minimum(sizes[others], sizes[x]) >= percent * np.maximum(sizes[others], sizes[x])) & (bits <= most_bits)
        others, bits = others[fits], bits[fits]
        for y in others[np.argsort(bits, kind="stable")].tolist():
            if forest.root(x) != forest.root(y) and linked(sets[x], sets[y], percent):
                forest.join(x, y)
                links.append((ids[x], ids[y]))
    return links


def confirm(members: DataFrame, n: int, percent: int, most_bits: float) -> DataFrame:
    """Links (a, b) within the groups of rows (group, side, id, sketch, text), sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        group = None

        def finish():
            ids, sides, sketches, sets = zip(*held)
            table = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(ids), -1)
            found = block_links(list(ids), np.array(sides), table, list(sets), percent, most_bits)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys, sides = batch.column("group").to_pylist(), batch.column("side").to_pylist()
            ids, sketches = batch.column("id").to_pylist(), batch.column("sketch").to_pylist()
            for low, high, data, offsets in slices(batch.column("text")):
                for k, one in zip(range(low, high), shingle_sets(data, offsets, n)):
                    if keys[k] != group and held:
                        yield finish()
                        held = []
                    group = keys[k]
                    held.append((ids[k], sides[k], sketches[k], one))
        if held:
            yield finish()

    return members.mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, n: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, id_column: str = "doc_id", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Linked are documents with 100 * intersection >= percent * union of their shingle sets; a
    component is named by its smallest id, and that document is kept. Null, empty and blank texts
    have no set, are linked with nothing and kept. Equal texts are one class whatever their number.
    Rows that repeat an id with equal text repeat the result; an id used for different texts links
    them. A row without an id never names a component that has other ids. Other columns are left out.
    """
    source = documents.selectExpr(f"cast(`{id_column}` as long) id", "cast(text as string) text")
    signed = materialize(sign(source, n, bands, rows), "signatures")
    full = signed.where("set_hash is not null and id is not null")
    classes = full.groupBy("set_hash").agg(F.min("id").alias("rep"))
    firsts = materialize(
        full.join(classes, (full.set_hash == classes.set_hash) & (full.id == classes.rep))
        .select("rep", "n_shingles", "sketch", "bands").dropDuplicates(["rep", "sketch"]), "classes",
    )
    keyed = firsts.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    star = keyed.join(shared.select("key", "least"), "key").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    clusters = components(star.distinct())
    placed = firsts.select("rep", "n_shingles", "sketch").join(clusters.withColumnRenamed("node", "rep"), "rep")
    sizes = placed.groupBy("component").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("blocks"))
    placed = placed.join(sizes, "component").select(
        F.col("rep").alias("id"), "sketch", "component", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("side")
    )
    texts = source.join(placed, "id")
    other = F.col("other")
    members = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("component", F.least("side", other), F.greatest("side", other)).alias("group"), "side", "id", "sketch", "text"
    )
    members = members.repartition("group").sortWithinPartitions("group")
    k = bands * rows
    links = confirm(members, n, percent, most_differing_bits(percent / 100, k))
    merged = components(links)
    named = classes.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_hash", F.coalesce("component", "rep").alias("component_id")
    )
    component = F.coalesce("component_id", "id")
    return signed.drop("bands", "sketch").join(named, "set_hash", "left").select(
        F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
