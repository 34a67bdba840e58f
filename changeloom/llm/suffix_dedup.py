"""Repeated byte strings by externally sorted, induced suffixes.

Only sampled suffixes are sorted: of the 27 suffixes that begin in a stretch of the fixed length
(50 bytes), the one whose 24-byte head has the least hash, the first of equals. The sample
depends on the stretch alone, so equal stretches have it at the same offset. Samples go through
Spark's external sort in buckets of bounded size, by the name of their head. Every other suffix is
induced from the next sampled one: its order among equals follows from the bytes put in front of
it, one more in each step, and from the common prefix up to the stretch's length.

Two rounds keep what is moved small. The first sorts names only and finds heads that occur in
different texts; the second sorts those samples again with the bytes around them and induces the
rest. Equal tuples of one task are merged before they are sent, so a passage in a third of all
documents costs one tuple per task and distinct surroundings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.worker import BLOCK, _powers, keep, mix, text_views
from changeloom.sources.shared import materialize

LENGTH, HEAD = 50, 24
STRETCH = LENGTH - HEAD + 1
PLACE = np.uint64((1 << 20) - 1)
NAME_BITS = np.uint64((1 << 40) - 1)  # within a bucket; a chance agreement only adds candidates
AROUND = STRETCH - 1 + LENGTH
FLUSH = 400_000
BUCKET_BYTES = 4_000_000
NAME = np.dtype([("name", "<u8"), ("text", "<u4"), ("doc", "<i8"), ("pos", "<i4")])
TUPLE = np.dtype([("name", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("bytes", f"S{AROUND}")])
SPAN = np.dtype([("low", "<i4"), ("high", "<i4")])
PACKED = "bucket int, doc long, data binary"


def samples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of a slice of at most a megabyte: row, place, name, first and last stretch."""
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    count = len(data) - LENGTH + 1
    if count <= 0:
        return none
    values, powers, inverse = keep("powers", _powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[:len(data)], out=sums[1:])
    heads = mix((sums[HEAD:] - sums[:-HEAD]) * inverse[:len(data) - HEAD + 1])
    least = (heads & ~PLACE) | np.arange(len(heads), dtype=np.uint64)
    width = 1
    while width < STRETCH:
        step = min(width, STRETCH - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lengths)), np.maximum(lengths - LENGTH + 1, 0))
    if len(rows) == 0:
        return none
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(np.maximum(lengths - LENGTH + 1, 0)) - np.maximum(lengths - LENGTH + 1, 0), np.maximum(lengths - LENGTH + 1, 0))
    begin = offsets[:-1][rows] + inside
    place = (least[begin] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[new[1:], len(place)] - 1
    return rows[new], place[new], heads[place[new]], begin[new], begin[last]


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of up to a megabyte: bytes, offsets, rows of the batch, and where in its text each begins.

    A longer text comes in pieces that share the bytes of all but one suffix of a stretch.
    """
    data, offsets = text_views(column)
    n, row = len(offsets) - 1, 0
    room = BLOCK - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + room, "right")) - 1
        if stop > row:
            stop = min(stop, n)
            yield data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row], np.arange(row, stop), np.zeros(stop - row, np.int64)
            row = stop
            continue
        at, end = int(offsets[row]), int(offsets[row + 1])
        while at + LENGTH <= end:
            high = min(at + room, end)
            yield data[at:high], np.array([0, high - at]), np.array([row]), np.array([at - offsets[row]])
            at = high - LENGTH + 1
        row += 1


def press(part: np.ndarray) -> bytes:
    """A table column by column and byte by byte, compressed."""
    import zstandard

    columns = [np.ascontiguousarray(part[n]).view(np.uint8).reshape(len(part), -1) for n in part.dtype.names]
    raw = b"".join((c if n == "bytes" else c.T).tobytes() for n, c in zip(part.dtype.names, columns))
    return zstandard.ZstdCompressor(level=5).compress(raw)


def expand(raw: bytes, kind: np.dtype) -> np.ndarray:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    n, at = len(data) // kind.itemsize, 0
    out = np.zeros(n, kind)
    for name in kind.names:
        width = kind[name].itemsize
        part = data[at:at + n * width]
        if name != "bytes":
            part = np.ascontiguousarray(part.reshape(width, n).T).ravel()
        out[name] = part.view(kind[name])
        at += n * width
    return out


def shrink(documents: DataFrame) -> DataFrame:
    """(id, text) with each text compressed, for the two joins that move whole texts."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]):
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = text_views(batch.column("text"))
            small = [compressor.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(small, pa.binary())], names=["id", "small"])

    return documents.mapInArrow(run, "id long, small binary")


def grown(column: pa.Array) -> pa.Array:
    """The texts of a column made by ``shrink``."""
    import zstandard

    expander = zstandard.ZstdDecompressor()
    return pa.array([expander.decompress(x.as_buffer()) for x in column], pa.binary()).cast(pa.large_binary()).cast(pa.large_string(), safe=False)


def packed(rows: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
    buckets, docs, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(docs, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "doc", "data"])


def by_bucket(entries: np.ndarray, buckets: int) -> list[tuple[int, None, bytes]]:
    spot = (entries["name"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(spot, kind="stable")
    ends = np.searchsorted(spot[order], np.arange(buckets + 1))
    entries = entries[order]
    entries["name"] &= NAME_BITS
    return [(k, None, press(entries[ends[k]:ends[k + 1]])) for k in np.flatnonzero(np.diff(ends)).tolist()]


def by_doc(docs: np.ndarray, values: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Findings as one row per document of a task; bucket -1."""
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    new = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.empty(0, np.int64)
    ends = np.r_[new[1:], len(docs)]
    return [(-1, int(docs[a]), values[a:b].tobytes()) for a, b in zip(new.tolist(), ends.tolist())]


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of equal entries of a sorted column begin, and each entry's group."""
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def shared_names(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted entries, one per name and text (the least document); which names are shared."""
    entries = entries[np.lexsort((entries["pos"], entries["doc"], entries["text"], entries["name"]))]
    start, owner = groups(entries["name"])
    low = np.minimum.reduceat(entries["text"], start) if len(start) else entries["text"]
    high = np.maximum.reduceat(entries["text"], start) if len(start) else entries["text"]
    marked = np.logical_or.reduceat(entries["pos"] < 0, start) if len(start) else low
    return entries, ((low != high) | marked.astype(bool))[owner]


def name_suffixes(documents: DataFrame, buckets: int) -> DataFrame:
    """Round one, map side: names by bucket; what is shared within the task is told at once."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, count = [], 0

        def flush():
            entries, shared = shared_names(np.concatenate(held))
            start, owner = groups(entries["name"])
            known = entries[shared]
            marks = entries[start][shared[start]]
            marks["pos"] = -1
            alone = entries[~shared]
            first, group = groups(alone["name"])
            least = np.minimum.reduceat(alone["doc"], first) if len(first) else alone["doc"]
            alone = alone[alone["doc"] == least[group]]
            sent = np.concatenate((alone, marks))
            sent = sent[np.lexsort((sent["pos"], sent["doc"]))]  # packs best in the order of the texts
            return packed(by_doc(known["doc"], known["pos"]) + by_bucket(sent, buckets))

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            texts = batch.column("text")
            data, offsets = text_views(texts)
            digest = np.array([int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=4).digest(), "little") for a, b in zip(offsets[:-1], offsets[1:])], np.uint32)
            for part, bounds, rows, base in pieces(texts):
                row, place, names, _, _ = samples(part, bounds)
                if not len(row):
                    continue
                entries = np.zeros(len(row), NAME)
                entries["name"], entries["text"], entries["doc"] = names, digest[rows[row]], ids[rows[row]]
                entries["pos"] = place - bounds[:-1][row] + base[row]
                held.append(entries)
                count += len(entries)
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return documents.mapInArrow(run, PACKED)


def merge_names(pieces_: DataFrame) -> DataFrame:
    """Round one, after the sort: places of the samples whose head occurs in different texts."""

    def told(held: list[np.ndarray]):
        entries, shared = shared_names(np.concatenate(held))
        known = entries[shared & (entries["pos"] >= 0)]
        return packed(by_doc(known["doc"], known["pos"]))

    return in_buckets(pieces_, NAME, told)


def in_buckets(frame: DataFrame, kind: np.dtype, work) -> DataFrame:
    """Apply ``work`` to the tables of each bucket; findings (bucket -1) pass through."""

    def run(batches: Iterator[pa.RecordBatch]):
        bucket, held = None, []
        for batch in batches:
            through = []
            for k, doc, raw in zip(batch.column("bucket").to_pylist(), batch.column("doc").to_pylist(), batch.column("data")):
                if k < 0:
                    through.append((k, doc, raw.as_py()))
                    continue
                if k != bucket and held:
                    yield work(held)
                    held = []
                bucket = k
                held.append(expand(raw.as_py(), kind))
            if through:
                yield packed(through)
        if held:
            yield work(held)

    spread = F.when(F.col("bucket") < 0, F.col("doc")).otherwise(F.col("bucket"))
    return frame.withColumn("to", F.xxhash64(spread)).repartition("to").sortWithinPartitions("bucket").drop("to").mapInArrow(run, PACKED)


def merged(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tuples with equal name, bytes and reach: those of the least document, and the others."""
    raw = np.ascontiguousarray(tuples["bytes"]).view("u1").reshape(len(tuples), AROUND)
    padded = np.zeros((len(tuples), AROUND + 8 - AROUND % 8), np.uint8)
    padded[:, :AROUND] = raw
    words = padded.view("<u8")
    key = tuples["name"] ^ mix((tuples["left"].astype(np.uint64) << np.uint64(8)) + tuples["right"])
    for k in range(words.shape[1]):
        key = mix(key + words[:, k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k))
    order = np.lexsort((tuples["doc"], key))
    tuples, key = tuples[order], key[order]
    start, owner = groups(key)
    mine = tuples["doc"] == tuples["doc"][start][owner]
    kept = tuples[mine]
    return kept[np.argsort(kept["name"], kind="stable")], tuples[~mine]


def induce(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hit stretches (doc, begin): those that a smaller document has too.

    Step by step one more byte stands before the sampled suffix; suffixes are equal up to the
    stretch's length when name, bytes before and bytes behind agree.
    """
    values, powers, _ = keep("powers", _powers)
    raw = np.ascontiguousarray(tuples["bytes"]).view("u1").reshape(len(tuples), AROUND)
    sums = np.zeros((AROUND + 1, len(tuples)), np.uint64)
    for k in range(AROUND):
        sums[k + 1] = sums[k] + values[raw[:, k]] * powers[k]
    docs, begins = [], []
    for before in range(STRETCH):
        at = np.flatnonzero((tuples["right"] <= before) & (before <= tuples["left"]))
        low = STRETCH - 1 - before
        key = mix(tuples["name"][at] + mix(sums[low + LENGTH, at] - sums[low, at]))
        order = np.argsort(key)
        start, owner = groups(key[order])
        if not len(start):
            continue
        doc = tuples["doc"][at][order]
        hit = doc > np.minimum.reduceat(doc, start)[owner]
        docs.append(doc[hit])
        begins.append(tuples["pos"][at][order][hit] - before)
    return (np.concatenate(docs), np.concatenate(begins)) if docs else (np.empty(0, np.int64), np.empty(0, np.int64))


def spans_of(docs: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Stretches [low, high] of begins as byte spans by document, joined where they touch."""
    order = np.lexsort((low, docs))
    docs, low, high = docs[order], low[order].astype(np.int64), high[order].astype(np.int64)
    fresh = np.r_[True, (docs[1:] != docs[:-1]) | (low[1:] > high[:-1] + LENGTH)] if len(docs) else np.empty(0, bool)
    start = np.flatnonzero(fresh)
    out = np.zeros(len(start), SPAN)
    if len(start):
        out["low"] = low[start]
        out["high"] = np.maximum.reduceat(high, start) + LENGTH
    return by_doc(docs[start], out)


def surround(documents: DataFrame, buckets: int) -> DataFrame:
    """Round two, map side: shared samples with the bytes around them; ``flags`` are their places."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, count = [], 0

        def flush():
            kept, later = merged(np.concatenate(held))
            begin = later["pos"].astype(np.int64)
            return packed(spans_of(later["doc"], begin - later["left"], begin - later["right"]) + by_bucket(kept, buckets))

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            flags = [np.unique(np.frombuffer(b"".join(x), "<i4")) for x in batch.column("flags").to_pylist()]
            for part, bounds, rows, base in pieces(grown(batch.column("small"))):
                row, place, names, low, high = samples(part, bounds)
                if not len(row):
                    continue
                pos = place - bounds[:-1][row] + base[row]
                edges = np.searchsorted(row, np.arange(len(rows) + 1))
                wanted = np.zeros(len(row), bool)
                for k in range(len(rows)):
                    a, b = edges[k], edges[k + 1]
                    wanted[a:b] = np.isin(pos[a:b], flags[rows[k]])
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                tuples = np.zeros(len(at), TUPLE)
                tuples["name"], tuples["doc"], tuples["pos"] = names[at], ids[rows[row[at]]], pos[at]
                tuples["left"], tuples["right"] = place[at] - low[at], place[at] - high[at]
                columns = place[at][:, None] + np.arange(1 - STRETCH, LENGTH)
                inside = (columns >= low[at][:, None]) & (columns < high[at][:, None] + LENGTH)
                around = np.where(inside, part[np.clip(columns, 0, len(part) - 1)], 0).astype(np.uint8)
                tuples["bytes"] = around.view(f"S{AROUND}").ravel()
                held.append(tuples)
                count += len(tuples)
                if count >= FLUSH // 2:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return documents.select("id", "small", "flags").mapInArrow(run, PACKED)


def hit_spans(tuples: DataFrame) -> DataFrame:
    def work(held: list[np.ndarray]):
        docs, begins = induce(np.concatenate(held))
        return packed(spans_of(docs, begins, begins))

    return in_buckets(tuples, TUPLE, work)


REMOVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_strings(documents: DataFrame, id_column: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Remove every byte within a 50-byte string that also begins in a document with a smaller id.

    Result: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256[, kept as binary]
    of every row. Texts are taken as bytes, nulls as empty; shorter texts lose nothing; matches are
    judged on the input. A row without an id loses nothing and matches nothing. Rows that repeat
    an id must have equal texts and count as one document. Other columns are left out.
    """
    source = documents.selectExpr(f"cast(`{id_column}` as long) id", "cast(text as string) text")
    named = source.where("id is not null and octet_length(text) >= 50")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(64, size // BUCKET_BYTES))
    digests = materialize(named.select("id", F.md5("text").alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.min("id").alias("first"))
    copies = materialize(digests.join(first, "digest").where("id > first").select("id").distinct(), "copies")
    flags = merge_names(name_suffixes(named, buckets)).groupBy(F.col("doc").alias("id")).agg(F.collect_list("data").alias("flags"))
    flagged = flags.join(copies, "id", "left_anti")
    spans = hit_spans(surround(shrink(named).join(flagged, "id"), buckets)).groupBy(F.col("doc").alias("id")).agg(F.collect_list("data").alias("spans"))
    found = spans.withColumn("copy", F.lit(False)).unionByName(
        copies.select("id", F.array().cast("array<binary>").alias("spans"), F.lit(True).alias("copy"))
    )
    found = found.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("copy").alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, offsets = text_views(grown(batch.column("small")))
            rows, kept = [], []
            for k, (spans_, copy) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("copy").to_pylist())):
                text = data[offsets[k]:offsets[k + 1]]
                gone = np.zeros(len(text) + 1, np.int32)
                if copy:
                    gone[0], gone[-1] = 1, -1
                elif spans_:
                    runs = np.frombuffer(b"".join(spans_), SPAN)
                    np.add.at(gone, runs["low"], 1)
                    np.add.at(gone, runs["high"], -1)
                mask = np.cumsum(gone)[:-1] > 0
                left = text[~mask].tobytes()
                starts = np.count_nonzero(mask[1:] & ~mask[:-1]) + bool(len(mask) and mask[0])
                rows.append((len(text), int(mask.sum()), int(starts), hashlib.sha256(left).hexdigest()))
                kept.append(left)
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            names = [id_column, *(f.split()[0] for f in REMOVED.split(", "))]
            if with_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=names)

    schema = f"`{id_column}` long, {REMOVED}" + ", kept binary" * with_text
    return shrink(source).join(found, "id", "left").select("id", "small", "spans", "copy").mapInArrow(run, schema)
