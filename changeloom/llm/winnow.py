"""Benchmark decontamination by winnowing.

Of every window of consecutive k-grams the one with the least hash is a fingerprint, for texts
and benchmark items alike, so any shared span of a full window shares a fingerprint. Fingerprint
hits are extended: every window around a hit is compared with the items' windows. Texts are never
moved. The benchmark goes to the tasks in blocks of bounded size; more blocks are more steps of
the same map-only pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.fertility import covered
from changeloom.llm.worker import alnum_words, gram_hashes, lower_table, slices, span_hashes, word_spans
from changeloom.sources.shared import materialize

WINDOW, GRAM = 13, 5
BLOCK_BYTES = 16 << 20
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


# Windows of one length, as plain arrays, which need no copy of this module where they are read:
# sorted fingerprints, and sorted window hashes with their items.
Items = tuple[np.ndarray, np.ndarray, np.ndarray]


def fingerprints(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed k-grams of windows of ``size`` words; ties all count."""
    gram = min(GRAM, size)
    span = size - gram + 1
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = gram_hashes(words, gram)
    least, width = grams, 1
    while width < span:  # doubling up to the widest power, then one overlap
        step = min(width, span - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    whole = rows[:count] == rows[size - 1:]
    chosen = np.zeros(len(grams), bool)
    for shift in range(span):
        chosen[shift:shift + count] |= whole & (grams[shift:shift + count] == least)
    at = np.flatnonzero(chosen)
    return at, grams[at]


def isin(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    place = np.searchsorted(table, values)
    return table[np.minimum(place, len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def prepare(texts: list[str]) -> dict[int, Items]:
    """Windows of the items by length; an item shorter than a window is one window itself."""
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    data = lower_table()[data]
    starts, ends, rows = word_spans(data, offsets, alnum_words())
    words = span_hashes(data, starts, ends)
    counts = np.bincount(rows, minlength=len(texts)) if len(rows) else np.zeros(len(texts), int)
    found = {}
    for size in sorted({min(int(c), WINDOW) for c in counts if c}):
        mine = counts >= WINDOW if size == WINDOW else counts == size
        pick = mine[rows]
        own, owners = words[pick], rows[pick]
        _, prints = fingerprints(own, owners, size)
        windows = gram_hashes(own, size)
        whole = owners[:len(windows)] == owners[size - 1:]
        order = np.argsort(windows[whole], kind="stable")
        found[size] = np.unique(prints), windows[whole][order], owners[:len(windows)][whole][order]
    return found


def hits(words: np.ndarray, rows: np.ndarray, items: dict[int, Items]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which words lie in an occurring window, and (row, item) of every occurrence."""
    marked, pairs = np.zeros(len(words), bool), []
    for size, (known, windows, owners) in items.items():
        at, prints = fingerprints(words, rows, size)
        at = at[isin(prints, known)]
        if len(at) == 0:
            continue
        span = size - min(GRAM, size) + 1
        begin = np.unique((at[:, None] - np.arange(span)).ravel())
        begin = begin[(begin >= 0) & (begin + size <= len(words))]
        begin = begin[rows[begin] == rows[begin + size - 1]]
        around = words[begin[:, None] + np.arange(size)]  # extension: whole windows around the hits
        keys = np.array([gram_hashes(one, size)[0] for one in around], np.uint64)
        good = isin(keys, windows)
        begin, keys = begin[good], keys[good]
        marked |= covered(begin, size, len(words))
        low, high = np.searchsorted(windows, keys), np.searchsorted(windows, keys, "right")
        for row, a, b in zip(rows[begin].tolist(), low.tolist(), high.tolist()):
            pairs.extend((row, int(item)) for item in owners[a:b])
    return marked, pairs


def scan(column: pa.Array, names: list[str], items: dict[int, Items]) -> Iterator[tuple[int, int, list]]:
    """Per slice: (word count, hit word positions, item names) of every row."""
    lower, word = lower_table(), alnum_words()
    for first, last, data, offsets in slices(column):
        data = lower[data]
        starts, ends, rows = word_spans(data, offsets, word)
        marked, pairs = hits(span_hashes(data, starts, ends), rows, items)
        bounds = np.searchsorted(rows, np.arange(last - first + 1))
        found: dict[int, set[str]] = {}
        for row, item in pairs:
            found.setdefault(row, set()).add(names[item])
        places = np.flatnonzero(marked)
        inside = np.searchsorted(places, bounds)
        yield first, last, [
            (int(bounds[k + 1] - bounds[k]), places[inside[k]:inside[k + 1]] - bounds[k], found.get(k, set()))
            for k in range(last - first)
        ]


def blocks_of(benchmark: DataFrame, item_id: str, block_bytes: int) -> Iterator[tuple[tuple[list[str], dict[int, Items]], bool]]:
    """Blocks of about ``block_bytes`` of the benchmark's text, and whether each is the last.

    Each is collected when it is asked for; an empty benchmark is one empty block.
    """
    source = benchmark.selectExpr(f"cast(`{item_id}` as string) item", "coalesce(cast(text as string), '') text").where("item is not null")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)

    def read(k: int) -> tuple[list[str], dict[int, Items]]:
        rows = source.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        return [r.item for r in rows], prepare([r.text for r in rows])

    if not n:
        yield ([], {}), True
    for k in range(n):
        yield read(k), k == n - 1


def verdict(words: int, places: np.ndarray, names: set[str]) -> tuple[int, int, int, str, bool]:
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return words, len(places), len(names), digest, len(places) > 0 and 20 * len(places) >= words


def _decide(documents: DataFrame, benchmark: DataFrame, item_id: str, block_bytes: int, finish, schema: T.StructType) -> DataFrame:
    """Scan block after block; earlier findings travel with the row, ``finish`` makes the output.

    A block is collected after the step of the one before is written and its broadcast destroyed, so
    the driver and the workers hold one block at a time.
    """
    spark = documents.sparkSession
    carried = T.StructType([*documents.schema.fields, T.StructField("_places", T.BinaryType()), T.StructField("_names", T.ArrayType(T.StringType()))])
    frame = documents
    for k, (block, last) in enumerate(blocks_of(benchmark, item_id, block_bytes)):
        held = spark.sparkContext.broadcast(block)
        del block

        def run(batches, held=held, last=last, earlier=k > 0):
            names, items = held.value
            for batch in batches:
                for low, high, found in scan(batch.column("text"), names, items):
                    part = batch.slice(low, high - low)
                    if earlier:
                        before = zip(part.column("_places").to_pylist(), part.column("_names").to_pylist())
                        found = [
                            (n, np.union1d(places, np.frombuffer(old, "<i8")), names_ | set(more))
                            for (n, places, names_), (old, more) in zip(found, before)
                        ]
                        part = part.select(part.schema.names[:-2])
                    if last:
                        yield finish(part, found)
                    else:
                        extra = [pa.array([p.astype("<i8").tobytes() for _, p, _ in found], pa.binary()),
                                 pa.array([sorted(x) for _, _, x in found], pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "_places", "_names"])

        frame = frame.mapInArrow(run, schema if last else carried)
        if not last:
            frame = materialize(frame, "decontamination")
            held.destroy()
    return frame


def contamination(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: words, hit words, occurring items, verdict.

    Null and empty texts have no words and are clean; so is everything beside an empty benchmark.
    Items with null ids or without words never occur; repeated items count once by id. Equal
    documents get equal rows; other columns are left out.
    """
    source = documents.selectExpr(f"cast(`{id_column}` as long) `{id_column}`", "cast(text as string) text")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    names = [id_column, *(f.split()[0] for f in RESULT.split(", "))]

    def finish(part, found):
        rows = list(zip(*(verdict(*f) for f in found)))
        return pa.RecordBatch.from_arrays([part.column(id_column), *(pa.array(r, kind) for r, kind in zip(rows, kinds))], names=names)

    schema = T.StructType.fromDDL(f"`{id_column}` long, {RESULT}")
    return _decide(source, benchmark, item_id, block_bytes, finish, schema)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""

    def finish(part, found):
        return part.filter(pa.array([not verdict(*f)[-1] for f in found], pa.bool_()))

    return _decide(documents, benchmark, item_id, block_bytes, finish, documents.schema)
