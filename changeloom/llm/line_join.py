"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity (a table of counts by hash, of fixed
size), and only the rarest few of a line, its prefix, are indexed: two lines as similar as the
threshold share a word of both prefixes. A pair found there must pass the length filter, the
positional filter and a parity bitmap, whose differing bits never exceed the differing words.
The bitmap grows with the line (64 to 512 bits): a small one of a long line lets unlike lines pass,
which in a large corpus connects most long lines to one cluster.
Words of 16,384 occurrences or more are indexed together with a second word each, which is as
exact because similar lines share at least two. Lines with equal sets count once. Lines of so few
words that they can only match an equal set (1 to 3 words at 0.8) have one entry, their set's hash.

Pairs that pass are gathered into clusters, whose lines meet in pairs of bounded blocks, where
Jaccard is computed on the full sets. A line goes if an earlier one (by id, then line number) is
equal or similar; matches are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.components import components
from changeloom.llm.worker import lower_table, mix, release, slices, space_words, span_hashes, stream, text_views, word_spans
from changeloom.sources.shared import materialize

TABLE_BITS, HASH_BITS, CLASS_BITS = 23, 35, 5
TOP = (1 << CLASS_BITS) - 1
HOT = 15  # class from which words are indexed with a second one: 16,384 occurrences and more
FLUSH_ENTRIES = 1 << 20
BUCKET_WORDS = 4_000_000
BLOCK_WORDS, BLOCK_LINES = 300_000, 3_000
SENT_BYTES, SENT_ENTRIES = 4 << 20, 1 << 15  # of one batch that a task sends; packed at a time
MATCH_ENTRIES = 200_000  # entries that are matched at a time; those of one token stay together
PAIRS = 1 << 17  # pairs that are held before they are reduced to connected runs
ROWS = 512  # rows that are taken from an Arrow batch as Python objects at a time
PARITIES = 8  # numbers of 64 parities in the widest bitmap
WIDTHS, SIZES = np.array([1, 2, 4, 8]), np.array([64, 160, 360])  # numbers in a bitmap, by the words up to which it serves
LINE = [("bits", "<u8", (PARITIES,)), ("set", "<u4"), ("doc", "<i8"), ("line", "<i4"), ("size", "<i4")]
ENTRY = np.dtype([("token", "<u8"), *LINE, ("pos", "<i4"), ("lead", "?")])
LINE = np.dtype(LINE)
PACKED = "bucket int, data binary"


def line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, row and line number (from 0 in its row) of every word of a slice."""
    data = lower_table()[data]
    starts, ends, rows = word_spans(data, offsets, space_words())
    breaks = np.flatnonzero(data == 0x0A)
    lines = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[rows]
    return span_hashes(data, starts, ends), rows, lines


def count_words(documents: DataFrame) -> np.ndarray:
    """Class of every slot of the count table: the number of bits of its words' count, 31 at most.

    Each task sends its counts once, in compressed blocks of two or four bytes a count; the table has a fixed size.
    """
    import zstandard

    part = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]):
        release()
        press = zstandard.ZstdCompressor(level=1)
        total = np.zeros(1 << TABLE_BITS, np.uint32)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                hashes, _, _ = line_words(data, offsets)
                np.add.at(total, hashes >> np.uint64(64 - TABLE_BITS), np.uint32(1))
        blocks = total.reshape(-1, part)
        most = blocks.max(1)
        keep = np.flatnonzero(most).tolist()
        sent = [press.compress(blocks[k].astype("<u2" if most[k] <= 0xFFFF else "<u4")) for k in keep]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array(sent, pa.binary())], names=["bucket", "data"])

    def add(batches):
        expand = zstandard.ZstdDecompressor()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                block = expand.decompress(raw.as_buffer())
                sums[k] = sums.get(k, 0) + np.frombuffer(block, "<u2" if len(block) == 2 * part else "<u4").astype(np.uint64)
        classes = {k: np.minimum(np.ceil(np.log2(v + 1)), TOP).astype(np.uint8) for k, v in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(classes), pa.int32()), pa.array([c.tobytes() for c in classes.values()], pa.binary())], names=["bucket", "data"])

    table = np.zeros((1 << TABLE_BITS) // part * part, np.uint8).reshape(-1, part)
    for row in documents.select("text").mapInArrow(count, PACKED).repartition("bucket").mapInArrow(add, PACKED).collect():
        table[row.bucket] = np.frombuffer(row.data, np.uint8)
    return table.ravel()


def set_hashes(hashes: np.ndarray, lines: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Hash of the word set, from whole word hashes, of the chosen lines (ascending numbers)."""
    if not len(chosen):
        return np.empty(0, np.uint64)
    listed = np.zeros(int(lines.max()) + 1, bool)
    listed[chosen] = True
    at = np.flatnonzero(listed[lines])
    at = at[np.lexsort((hashes[at], lines[at]))]
    word, line = hashes[at], lines[at]
    new = np.r_[True, (line[1:] != line[:-1]) | (word[1:] != word[:-1])]
    word, line = word[new], line[new]
    begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    return mix(np.add.reduceat(mix(word), begin) + np.diff(np.r_[begin, len(line)]).astype(np.uint64))


def bitmaps(spread: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parities of every line's words, whose spread hashes lie side by side, in as many numbers as its size asks for.

    Numbers ``k`` and ``k + n`` of a bitmap of ``2 n`` numbers, XORed, are number ``k`` of one of ``n``.
    """
    width = WIDTHS[np.searchsorted(SIZES, size)]
    bit = np.uint64(1) << (spread >> np.uint64(58))
    number = (spread >> np.uint64(55)).astype(np.int64) & (np.repeat(width, size) - 1)
    out = np.zeros((len(size), PARITIES), np.uint64)
    out[:, 0] = np.bitwise_xor.reduceat(np.where(number == 0, bit, np.uint64(0)), begin)
    for k in range(1, int(width.max(initial=1))):
        if k in WIDTHS:  # leave the lines behind which have no further numbers
            long = np.flatnonzero(width > k)
            at = np.flatnonzero(np.repeat(width > k, size))
            first, one, its = np.cumsum(size[long]) - size[long], bit[at], number[at]
        out[long, k] = np.bitwise_xor.reduceat(np.where(its == k, one, np.uint64(0)), first)
    return out


def bits_apart(bits: np.ndarray, width: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing parities of pairs of lines, the right one as long or longer; its bitmap is folded to the left one's."""
    kinds = width[left] * (PARITIES + 1) + width[right]
    apart = np.empty(len(left), np.int64)
    for kind in np.flatnonzero(np.bincount(kinds)).tolist():
        n, m = divmod(kind, PARITIES + 1)
        at = np.flatnonzero(kinds == kind)
        wide = bits[right[at], :m]
        while wide.shape[1] > n:
            wide = wide[:, :wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2:]
        apart[at] = np.bitwise_count(bits[left[at], :n] ^ wide).sum(1, dtype=np.int64)
    return apart


def prefixes(hashes: np.ndarray, lines: np.ndarray, classes: np.ndarray, percent: int, least: int) -> tuple[np.ndarray, ...]:
    """Entries (token, index of the line, position) of lines of ``least`` words or more, and of every
    line its number, size, bitmap and set hash. ``lines`` are ascending line numbers of a slice."""
    key = (lines.astype(np.uint64) << np.uint64(HASH_BITS + CLASS_BITS)) | (
        classes[hashes >> np.uint64(64 - TABLE_BITS)].astype(np.uint64) << np.uint64(HASH_BITS)
    ) | (hashes & np.uint64((1 << HASH_BITS) - 1))
    key = np.sort(key)
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    owner = (key >> np.uint64(HASH_BITS + CLASS_BITS)).astype(np.int64)
    token = key & np.uint64((1 << HASH_BITS + CLASS_BITS) - 1)
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
    size = np.diff(np.r_[begin, len(owner)])
    if len(begin) == 0:
        return (np.empty(0, np.uint64),) + tuple(np.empty(0, np.int64) for _ in range(6))
    spread = mix(token)
    sets = (mix(np.add.reduceat(spread, begin) + size.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    bits = bitmaps(spread, begin, size)
    ok, few = size >= least, size * (100 - percent) < percent  # one word more or less is already below the threshold
    short = np.flatnonzero(ok & few & (token[begin] >> np.uint64(HASH_BITS) > 1))
    wide = set_hashes(hashes, lines, owner[begin[short]])
    bits[short], sets[short] = 0, (wide >> np.uint64(32)).astype(np.uint32)
    bits[short, 0] = wide
    prefix = size - -(-percent * size // 100) + 1
    pos = np.arange(len(owner)) - np.repeat(begin, size)
    # A word which the whole corpus holds once is in no other line.
    taken = (pos < np.repeat(prefix, size)) & np.repeat(ok & ~few, size) & (token >> np.uint64(HASH_BITS) > 1)
    at = np.flatnonzero(taken)
    row = np.repeat(np.arange(len(begin)), size)[at]
    hot = token[at] >> np.uint64(HASH_BITS) >= HOT
    tokens, rows, places = [wide, token[at[~hot]]], [short, row[~hot]], [np.zeros(len(short), np.int64), pos[at[~hot]]]
    for k in np.flatnonzero(hot).tolist():  # with every later word of the prefix of two
        i, r = at[k], row[k]
        partners = token[i + 1:begin[r] + prefix[r] + 1]
        tokens.append(mix(token[i] * np.uint64(3) + partners * np.uint64(0x9E3779B97F4A7C15)))
        rows.append(np.full(len(partners), r))
        places.append(np.full(len(partners), pos[i]))
    return np.concatenate(tokens), np.concatenate(rows), np.concatenate(places), owner[begin], size, bits, sets


def identity(table: np.ndarray) -> np.ndarray:
    """One value per word set, of its hash, its parities and its size."""
    wide = table["bits"][:, 0].copy()
    for k, factor in enumerate(stream(61, PARITIES - 1) | np.uint64(1), 1):
        wide += table["bits"][:, k] * factor
    wide = mix(wide)
    return mix(wide + (table["set"].astype(np.uint64) << np.uint64(24)) + table["size"].astype(np.uint64))


def firsts(sets: np.ndarray, docs: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are the earliest of their set, and which follow an earlier one."""
    order = np.lexsort((lines, docs, sets))
    new = np.r_[True, sets[order][1:] != sets[order][:-1]] if len(order) else np.empty(0, bool)
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    first, later = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
    first[order[new]] = True
    later[order] = (docs[order] != docs[head]) | (lines[order] != lines[head])
    return first, later


def index_lines(documents: DataFrame, classes, percent: int, least: int, buckets: int) -> DataFrame:
    """Entries of all lines in packed pieces by bucket; pieces of bucket -1 and below are removals."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]):
        release()
        press = zstandard.ZstdCompressor(level=1)
        held, count, base = [], 0, 0

        def flush():
            tokens, owner, place, lead, table = (np.concatenate(x) for x in zip(*held))
            held.clear()
            first, later = firsts(identity(table), table["doc"], table["line"])
            at = np.flatnonzero(first[owner])
            spot = (mix(tokens[at]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(spot, kind="stable")
            ends = np.searchsorted(spot[order], np.arange(buckets + 1))
            at = at[order]
            del spot, order
            pieces, size, low = [], 0, 0
            while low < buckets:  # some buckets at a time
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + SENT_ENTRIES, "right")) - 1)
                one = at[ends[low]:ends[high]]
                entries = np.zeros(len(one), ENTRY)
                entries["token"], entries["pos"], entries["lead"] = tokens[one], place[one], lead[one]
                for name in LINE.names:
                    entries[name] = table[name][owner[one]]
                for k in (low + np.flatnonzero(np.diff(ends[low:high + 1]))).tolist():
                    pieces.append((k, pack(entries[ends[k] - ends[low]:ends[k + 1] - ends[low]])))
                    size += len(pieces[-1][1])
                if size > SENT_BYTES:
                    yield batch_of(pieces)
                    pieces, size = [], 0
                low = high
            gone = np.zeros(np.count_nonzero(later), ENTRY)
            for name in LINE.names:
                gone[name] = table[name][later]
            if len(gone):
                pieces.append((-1 - int(gone["doc"][0] % 997), pack(gone)))
            if pieces:
                yield batch_of(pieces)

        def batch_of(pieces):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([d for _, d in pieces], pa.binary())], names=["bucket", "data"])

        def pack(part: np.ndarray) -> bytes:
            columns = [np.ascontiguousarray(part[name]).view(np.uint8).reshape(len(part), -1).T.tobytes() for name in ENTRY.names]
            return press.compress(b"".join(columns))

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for low, high, data, offsets in slices(batch.column("text")):
                hashes, rows, lines = line_words(data, offsets)
                numbers = np.cumsum(np.r_[0, (rows[1:] != rows[:-1]) | (lines[1:] != lines[:-1])]) if len(rows) else np.empty(0, np.int64)
                start = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(rows) else np.empty(0, np.int64)
                tokens, row, pos, owner, size, bits, sets = prefixes(hashes, numbers, classes.value, percent, least)
                if not len(tokens):
                    continue
                enough = np.flatnonzero(size >= least)
                table = np.zeros(len(enough), LINE)
                spot = start[owner[enough]]
                table["doc"], table["line"] = ids[low:high][rows[spot]], lines[spot]
                table["size"], table["bits"], table["set"] = size[enough], bits[enough], sets[enough]
                lead = np.zeros(len(row), bool)
                lead[np.unique(row, return_index=True)[1]] = True
                # Entries are held as numbers of their lines, and written out bucket by bucket.
                held.append((tokens, (base + np.searchsorted(enough, row)).astype(np.int32), pos.astype(np.int32), lead, table))
                count, base = count + len(tokens), base + len(table)
                if count >= FLUSH_ENTRIES:
                    yield from flush()
                    count = base = 0
        if held:
            yield from flush()

    return documents.mapInArrow(run, PACKED)


def unpack(raw: bytes, expand) -> np.ndarray:
    data = np.frombuffer(expand.decompress(raw), np.uint8)
    n, at = len(data) // ENTRY.itemsize, 0
    out = np.empty(n, ENTRY)
    for name in ENTRY.names:
        kind, width = ENTRY[name].base, ENTRY[name].itemsize
        out[name] = np.ascontiguousarray(data[at:at + n * width].reshape(width, n).T).view(kind).reshape(out[name].shape)
        at += n * width
    return out


def tokens_of(raw: bytes, expand) -> np.ndarray:
    """The tokens of a packed piece; they are its first column."""
    data = np.frombuffer(expand.decompress(raw), np.uint8)
    n, width = len(data) // ENTRY.itemsize, ENTRY["token"].itemsize
    return np.ascontiguousarray(data[:n * width].reshape(width, n).T).view(ENTRY["token"]).ravel()


def similar_runs(entries: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of entries of one token that pass the length, positional and bitmap filters.

    Entries are sorted by token and size, so those that fit an entry's length follow it.
    """
    n, size, pos = len(entries), entries["size"].astype(np.int64), entries["pos"].astype(np.int64)
    bits, width, rest = entries["bits"], WIDTHS[np.searchsorted(SIZES, size)], size - pos
    run = np.cumsum(np.r_[0, entries["token"][1:] != entries["token"][:-1]]) * (100 * size.max(initial=0) // percent + 1)
    fits = np.searchsorted(run + size, run + 100 * size // percent, "right") - np.arange(n) - 1
    total, low = np.cumsum(fits), 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")))
        left = np.repeat(np.arange(low, high), fits[low:high])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[low:high] - fits[low:high] - (total[low] - fits[low]), fits[low:high])
        low = high
        both = size[left] + size[right]
        need = -(-percent * both // (100 + percent))
        # Words from the shared one on, and those before it, which can match as well.
        reach = np.minimum(rest[left], rest[right]) + np.minimum(pos[left], pos[right])
        good = np.flatnonzero(reach >= need)
        left, right, most = left[good], right[good], (both - 2 * need)[good]
        good = bits_apart(bits, width, left, right) <= most
        if good.any():
            yield left[good], right[good]


def connected(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pairs of ``n`` entries, and the least entry that each is connected with."""
    parent = np.arange(n)
    while True:
        least = np.minimum(parent[left], parent[right])
        before = parent.copy()
        np.minimum.at(parent, left, least)
        np.minimum.at(parent, right, least)
        parent = parent[parent]
        if (parent == before).all():
            break
    ends = np.unique(np.r_[left, right])
    return ends, parent[ends]


def similar_stars(entries: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that may be similar to another one, and the least entry of each one's connected run.

    Pairs are reduced whenever there are many, as a run of similar lines has its square of them.
    """
    left, right, count = [], [], 0
    for a, b in similar_runs(entries, percent):
        left.append(a)
        right.append(b)
        count += len(a)
        if count >= PAIRS:
            ends, heads = connected(len(entries), np.concatenate(left), np.concatenate(right))
            left, right, count = [ends], [heads], 0
    return connected(len(entries), np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


EDGES = "removed boolean, a struct<doc:long,line:int>, b struct<doc:long,line:int>, size int"


def edge_batch(removed: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    ref = lambda x: pa.StructArray.from_arrays([pa.array(x["doc"]), pa.array(x["line"])], ["doc", "line"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), removed)), ref(a), ref(b), pa.array(a["size"])], names=["removed", "a", "b", "size"])


def match_entries(pieces: DataFrame, percent: int) -> DataFrame:
    """Removed lines (equal sets), and edges between lines that may be similar, bucket by bucket."""
    import zstandard

    def match(entries: np.ndarray):
        sets = identity(entries)
        order = np.lexsort((entries["line"], entries["doc"], sets, entries["size"], entries["token"]))
        entries, sets = entries[order], sets[order]
        same = np.r_[False, (entries["token"][1:] == entries["token"][:-1]) & (sets[1:] == sets[:-1])]
        head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        gone = same & entries["lead"] & ((entries["doc"] != entries["doc"][head]) | (entries["line"] != entries["line"][head]))
        if gone.any():
            yield edge_batch(True, entries[gone], entries[head[gone]])
        entries = entries[~same]
        ends, heads = similar_stars(entries, percent)
        if len(ends):
            yield edge_batch(False, entries[ends], entries[heads])

    def by_tokens(held: list[bytes], expand):
        """Matches the pieces of a bucket, some of its tokens at a time."""
        tokens, counts = np.unique(np.concatenate([tokens_of(raw, expand) for raw in held]), return_counts=True)
        tokens, counts = tokens[counts > 1], counts[counts > 1]  # words that occur once more at least
        turn = (np.cumsum(counts) - 1) // MATCH_ENTRIES
        for k in np.unique(turn).tolist():
            chosen, parts = tokens[turn == k], []
            for raw in held:
                part = unpack(raw, expand)
                at = np.minimum(np.searchsorted(chosen, part["token"]), len(chosen) - 1)
                parts.append(part[chosen[at] == part["token"]])
            yield from match(np.concatenate(parts))

    def run(batches: Iterator[pa.RecordBatch]):
        release()
        expand, bucket, held = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            for k, raw in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                if k < 0:
                    part = unpack(raw.as_py(), expand)
                    yield edge_batch(True, part, part)
                    continue
                if k != bucket and held:
                    yield from by_tokens(held, expand)
                    held = []
                bucket = k
                held.append(raw.as_py())
        if held:
            yield from by_tokens(held, expand)

    return pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, EDGES)


def wanted_lines(documents: DataFrame, places: DataFrame) -> DataFrame:
    """Texts of the placed lines, once for every block their own block meets."""
    listed = places.groupBy(F.col("node.doc").alias("id")).agg(F.collect_list(F.struct(F.col("node.line").alias("line"), "cluster", "blocks")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]):
        release()
        for batch in batches:
            out = []
            data, offsets = text_views(batch.column("text"))
            for k, (doc, wanted) in enumerate(zip(batch.column("id"), batch.column("wanted"))):
                doc, lines = doc.as_py(), data[offsets[k]:offsets[k + 1]].tobytes().split(b"\n")
                for one in wanted.as_py():
                    line, blocks = one["line"], one["blocks"]
                    side = int(mix(np.array([doc * 1_000_003 + line & 0x7FFFFFFFFFFFFFFF], np.uint64))[0] % np.uint64(blocks))
                    for other in range(blocks):
                        low, high = min(side, other), max(side, other)
                        out.append((f"{one['cluster']['doc']}:{one['cluster']['line']}:{low}:{high}", side, doc, line, lines[line]))
                if len(out) > 4_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    def batch_of(rows):
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=["group", "side", "doc", "line", "text"])

    return documents.join(listed, "id").select("id", "text", "wanted").mapInArrow(run, "group string, side int, doc long, line int, text binary")


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of 512 parities; differing bits never exceed the differing words."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    spot = (mix(np.concatenate(sets)) & np.uint64(511)).astype(np.int64)
    table = np.bincount(owner * 512 + spot, minlength=512 * len(sets)) & 1
    return np.packbits(table.astype(np.uint8).reshape(len(sets), 512), axis=1).view(np.uint64)


def confirm(lines: DataFrame, percent: int) -> DataFrame:
    """(doc, line) of lines with an earlier line of a Jaccard similarity of the threshold or more."""

    def judge(rows: list[tuple]):
        rows = sorted(rows, key=lambda r: (r[1], r[2]))
        side = np.array([r[0] for r in rows])
        sets = [r[3] for r in rows]
        size, bits = np.array([len(x) for x in sets]), parities(sets)
        inside, gone = side.min() == side.max(), []
        for k in range(1, len(rows)):
            # Earlier lines: of the other block, or of the block itself if the group has one only.
            fits = (size[:k] * 100 >= percent * size[k]) & (size[k] * 100 >= percent * size[:k])
            if not inside:
                fits &= side[:k] != side[k]
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            apart = np.bitwise_count(bits[at] ^ bits[k]).sum(1, dtype=np.int64)
            both = size[at] + size[k]
            near = apart <= both - 2 * -(-percent * both // (100 + percent))
            at, apart = at[near], apart[near]
            for j in at[np.argsort(apart, kind="stable")].tolist():  # the likeliest first
                shared = len(np.intersect1d(sets[j], sets[k], assume_unique=True))
                if 100 * shared >= percent * (size[j] + size[k] - shared):
                    gone.append(k)
                    break
        found = [rows[k] for k in gone]
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.int32())], names=["doc", "line"])

    def run(batches: Iterator[pa.RecordBatch]):
        release()
        lower, word = lower_table(), space_words()
        group, held = None, []
        for part in (batch.slice(k, ROWS) for batch in batches for k in range(0, len(batch), ROWS)):
            for key, side, doc, line, text in zip(*(part.column(k).to_pylist() for k in range(5))):
                if key != group and held:
                    yield judge(held)
                    held = []
                group = key
                data = lower[np.frombuffer(text, np.uint8)]
                starts, ends, _ = word_spans(data, np.array([0, len(data)]), word)
                held.append((side, doc, line, np.unique(span_hashes(data, starts, ends))))
        if held:
            yield judge(held)

    return lines.repartition("group").sortWithinPartitions("group").mapInArrow(run, "doc long, line int")


def similar_lines(documents: DataFrame, percent: int = 80, least_words: int = 1, id_column: str = "doc_id") -> DataFrame:
    """(doc, line): every line, numbered from 0, that has an equal or similar earlier line.

    Lines of fewer than ``least_words`` distinct words are left alone; so are null and empty texts
    and rows without an id. Rows that repeat an id count as one document. An empty table has none.
    """
    spark = documents.sparkSession
    source = documents.selectExpr(f"cast(`{id_column}` as long) id", "cast(text as string) text").where("id is not null")
    classes = spark.sparkContext.broadcast(count_words(source))  # 8 MB whatever the input
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, size // BUCKET_WORDS)
    pieces = index_lines(source, classes, percent, least_words, int(buckets))
    found = materialize(match_entries(pieces, percent), "line-edges")
    equal = found.where("removed").select("a.doc", "a.line")
    edges = found.where("not removed")
    clusters = components(edges.select("a", "b"))
    sized = edges.select("a", "size").dropDuplicates(["a"]).join(clusters.withColumnRenamed("node", "a"), "a")
    blocks = sized.groupBy("component").agg(
        F.ceil(F.greatest(F.sum("size") / BLOCK_WORDS, F.count("*") / BLOCK_LINES)).cast("int").alias("blocks")
    )
    places = clusters.join(blocks, "component").select("node", F.col("component").alias("cluster"), "blocks")
    similar = confirm(wanted_lines(source, places), percent)
    return equal.union(similar).distinct()


def drop_lines(documents: DataFrame, removed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Documents without the removed lines (doc, line), all columns kept; other texts stay as they are."""
    listed = removed.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("line").alias("_gone"))
    left = F.filter(F.split("text", "\n", -1), lambda _, k: ~F.array_contains("_gone", k))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return documents.join(listed, F.col(id_column).cast("long") == F.col("_doc"), "left").withColumn("text", text).select(*documents.columns)


def line_report(documents: DataFrame, percent: int = 80, least_words: int = 1, id_column: str = "doc_id") -> DataFrame:
    """(id, n_lines, n_removed, removed_lines) of every row; a null or empty text has one empty line.

    All lines with a word are judged, however short.
    """
    gone = similar_lines(documents, percent, least_words, id_column)
    listed = gone.groupBy(F.col("doc").alias("_doc")).agg(F.sort_array(F.collect_list("line")).alias("_gone"))
    rows = documents.select(
        F.col(id_column).cast("long").alias(id_column),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
    )
    none = F.array().cast("array<int>")
    return rows.join(listed, rows[id_column] == F.col("_doc"), "left").select(
        id_column, F.coalesce("n_lines", F.lit(1).cast("long")).alias("n_lines"),
        F.coalesce(F.size(F.coalesce("_gone", none)), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.coalesce("_gone", none).cast("array<string>"), ",").alias("removed_lines"),
    )
