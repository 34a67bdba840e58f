"""Ranked search with bounds of term pairs.

Texts become shards of postings: every distinct word with its documents and counts. For a block of
queries a shard keeps the impacts of the queries' words, their largest impact, and, for pairs of
heavy words of one query, the documents that hold both with the largest joint impact.

A query meets a shard by MaxScore: the words whose bounds together stay below the score of the
last place so far cannot bring a document in alone, so only the documents of the other words are
candidates. Words are coupled in pairs where the joint maximum lies below the sum of the two; a
document holds both, and then scores the joint maximum at most, or one. Candidates meet the
couples left over by falling bound, and go as soon as they cannot reach the last place.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from changeloom.llm.worker import alnum_words, lower_table, slices, span_hashes, word_spans
from changeloom.sources.shared import materialize

SHARD_BYTES = 4 << 20
QUERY_BYTES = 4 << 20
PAIRED = 8  # heaviest words of a query of which every pair gets a list
POSTINGS = "ids array<long>, sizes binary, terms binary, ends binary, docs binary, counts binary, n_docs long, n_words long"
IMPACTS = "ids array<long>, terms binary, ends binary, docs binary, impacts binary, maxima binary, pairs binary, pair_ends binary, pair_docs binary, joint binary"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a slice."""
    data = lower_table()[data]
    starts, ends, rows = word_spans(data, offsets, alnum_words())
    return span_hashes(data, starts, ends), rows


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"array<long>": pa.list_(pa.int64()), "binary": pa.binary(), "long": pa.int64()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def postings_of(ids: list, hashes: np.ndarray, rows: np.ndarray) -> tuple:
    """One shard: distinct words in ascending order of hash, with ascending rows and counts."""
    n = len(ids)
    order = np.argsort(hashes, kind="stable")  # rows ascend, so they do within a word
    word, row = hashes[order], rows[order]
    new = np.r_[True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])] if len(word) else np.empty(0, bool)
    at = np.flatnonzero(new)
    counts, word, row = np.diff(np.r_[at, len(new)]), word[at], row[at]
    last = np.flatnonzero(np.r_[word[1:] != word[:-1], True]) if len(word) else at
    sizes = np.bincount(rows, minlength=n)
    return (
        ids, sizes.astype("<i8").tobytes(), word[last].astype("<u8").tobytes(), (last + 1).astype("<i8").tobytes(),
        row.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), int((sizes > 0).sum()), int(sizes.sum()),
    )


def build_index(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Postings of whole texts in shards of about ``SHARD_BYTES`` of text, written once."""

    def run(batches: Iterator[pa.RecordBatch]):
        ids, hashes, rows, held = [], [], [], 0
        for batch in batches:
            names = batch.column("id").to_pylist()
            for low, high, data, offsets in slices(batch.column("text")):
                words, row = words_of(data, offsets)
                hashes.append(words)
                rows.append(row + len(ids))
                ids.extend(names[low:high])
                held += len(data)
                if held >= SHARD_BYTES:
                    yield batch_of(POSTINGS, [postings_of(ids, np.concatenate(hashes), np.concatenate(rows))])
                    ids, hashes, rows, held = [], [], [], 0
        if ids:
            yield batch_of(POSTINGS, [postings_of(ids, np.concatenate(hashes), np.concatenate(rows))])

    source = documents.selectExpr(f"cast(`{id_column}` as long) id", "cast(text as string) text")
    return materialize(source.mapInArrow(run, POSTINGS), "postings")


def query_blocks(benchmark: DataFrame, item_id: str) -> Iterator[list[tuple]]:
    """Distinct (id, text) in blocks of about ``QUERY_BYTES`` of text, one at a time."""
    source = benchmark.select(F.col(item_id).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    for k in range(blocks):
        yield [tuple(r) for r in source.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()]


def query_words(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Distinct words of a block, and per query the places of its own among them with their counts."""
    raw = [t.encode() for t in texts]
    hashes, rows = words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw]))
    words, places = np.unique(hashes, return_inverse=True)
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    return words, [np.unique(places[a:b], return_counts=True) for a, b in zip(bounds, bounds[1:])]


def meeting(words: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal values in two ascending arrays."""
    at = np.searchsorted(terms, words)
    here = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == words) if len(terms) else np.empty(0, np.int64)
    return here, at[here]


def document_counts(index: DataFrame, words: np.ndarray) -> np.ndarray:
    """Number of documents that hold each word of a query block."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column("terms"), batch.column("ends")):
                here, at = meeting(words, np.frombuffer(terms.as_buffer(), "<u8"))
                total[here] += np.diff(np.r_[0, np.frombuffer(ends.as_buffer(), "<i8")])[at]
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(total[here], pa.int64())], names=["word", "n"])

    out = np.zeros(len(words), np.int64)
    for row in index.select("terms", "ends").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[row.word] = row.n
    return out


def weights_of(documents: int, counts: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in counts.tolist()], np.int64)


def paired(queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Pairs of heavy words of one query that documents hold, as (smaller place, larger place)."""
    pairs = set()
    for places, times in queries:
        heavy = places[np.argsort(-weights[places] * times * (counts[places] > 0), kind="stable")][:PAIRED]
        pairs.update(combinations(sorted(heavy[counts[heavy] > 0].tolist()), 2))
    return np.array(sorted(pairs), np.int64).reshape(-1, 2)


def impacts(index: DataFrame, words: np.ndarray, weights: np.ndarray, pairs: np.ndarray, documents: int, length: int) -> DataFrame:
    """Per shard: impacts of the queries' words, their maxima, and the lists of the pairs."""

    def shard(row: dict) -> tuple:
        read = lambda name, kind: np.frombuffer(row[name], kind)
        here, at = meeting(words, read("terms", "<u8"))
        ends = np.r_[0, read("ends", "<i8")]
        size = ends[at + 1] - ends[at]
        after = np.cumsum(size)
        pick = np.repeat(ends[at] - (after - size), size) + np.arange(after[-1] if len(after) else 0)
        docs, counts = read("docs", "<i4")[pick], read("counts", "<i4")[pick].astype(np.int64)
        norm = 75 + 25 * read("sizes", "<i8") * documents // max(length, 1)
        impact = np.repeat(weights[here], size) * (1_000_000_000 * counts // (1_000 * counts + 12 * norm[docs]))
        starts = after - size
        maxima = np.maximum.reduceat(impact, starts) if len(here) else impact
        place = np.full(len(words), -1)
        place[here] = np.arange(len(here))
        both = place[pairs]
        both = both[(both >= 0).all(1)]
        lists, joint = [], []
        for i, j in both.tolist():
            a, b = slice(starts[i], after[i]), slice(starts[j], after[j])
            shared, x, y = np.intersect1d(docs[a], docs[b], assume_unique=True, return_indices=True)
            lists.append(shared)
            joint.append(int((impact[a][x] + impact[b][y]).max(initial=0)))
        return (
            row["ids"], here.astype("<i4").tobytes(), after.astype("<i8").tobytes(), docs.tobytes(), impact.astype("<i8").tobytes(),
            maxima.astype("<i8").tobytes(), both.astype("<i4").tobytes(), np.cumsum([len(x) for x in lists]).astype("<i8").tobytes(),
            np.concatenate(lists).astype("<i4").tobytes() if lists else b"", np.array(joint, "<i8").tobytes(),
        )

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch_of(IMPACTS, [shard(batch.slice(k, 1).to_pylist()[0])])

    return materialize(index.drop("n_docs", "n_words").mapInArrow(run, IMPACTS), "impacts")


class Shard:
    """Arrays of one row of the impact table."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids = np.array([0 if x is None else x for x in row["ids"]], np.int64)
        self.named = np.array([x is not None for x in row["ids"]], bool)
        self.terms, self.maxima = read("terms", "<i4"), read("maxima", "<i8")
        self.bounds = np.r_[0, read("ends", "<i8")]
        self.docs, self.impacts = read("docs", "<i4"), read("impacts", "<i8")
        ends = np.r_[0, read("pair_ends", "<i8")] if row["pairs"] else np.zeros(1, np.int64)
        both, docs = read("pairs", "<i4").reshape(-1, 2), read("pair_docs", "<i4")
        self.pairs = {(int(i), int(j)): (int(most), docs[a:b]) for (i, j), most, a, b in zip(both, read("joint", "<i8"), ends, ends[1:])}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.bounds[term], self.bounds[term + 1])
        return self.docs[part], self.impacts[part]


def couples(terms: list[int], times: list[int], maxima: list[int], pairs: dict) -> list[tuple[int, list[int], int, np.ndarray | None]]:
    """(bound, places of its words, bound without both, documents with both), by ascending bound.

    Pairs that save most against the sum of their maxima are coupled first, each word once.
    """
    place = {t: k for k, t in enumerate(terms)}
    offers = []
    for i, j in combinations(sorted(terms), 2):
        if (i, j) in pairs:
            joint, shared = pairs[i, j]
            a, b = place[i], place[j]
            alone = max(maxima[a], maxima[b])
            joint = min(joint * max(times[a], times[b]), maxima[a] + maxima[b]) if len(shared) else 0
            offers.append((maxima[a] + maxima[b] - max(joint, alone), a, b, joint, alone, shared))
    used, units = set(), []
    for saved, a, b, joint, alone, shared in sorted(offers, key=lambda x: (-x[0], x[1], x[2])):
        if saved > 0 and not {a, b} & used:
            used |= {a, b}
            units.append((max(joint, alone), [a, b], alone, shared))
    units += [(maxima[k], [k], maxima[k], None) for k in range(len(terms)) if k not in used]
    return sorted(units, key=lambda x: (x[0], x[1]))


def search_shard(shard: Shard, terms: list[int], times: list[int], threshold: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the documents that reach the threshold, and how many were candidates.

    Every document of the shard's own first ``most`` that reaches the threshold is among them.
    """
    maxima = [int(shard.maxima[t]) * c for t, c in zip(terms, times)]
    units = couples(terms, times, maxima, shard.pairs)
    sums = np.cumsum([u[0] for u in units])
    first = int(np.searchsorted(sums, threshold))  # the couples before cannot reach the threshold together
    score, candidate = np.zeros(len(shard.ids), np.int64), np.zeros(len(shard.ids), bool)
    for _, members, _, _ in units[first:]:
        for k in members:
            docs, impact = shard.postings(terms[k])
            score[docs] += impact * times[k]
            candidate[docs] = True
    alive = np.flatnonzero(candidate & shard.named)
    tried = len(alive)
    for k in range(first - 1, -1, -1):
        if len(alive) > most:  # what is found so far is a lower bound of every score
            threshold = max(threshold, int(np.partition(score[alive], -most)[-most]))
        bound, members, alone, shared = units[k]
        below = int(sums[k - 1]) if k else 0
        if shared is None:
            reach = bound
        else:
            reach = np.where(np.isin(alive, shared, assume_unique=True), bound, alone)
        alive = alive[score[alive] + below + reach >= threshold]
        if not len(alive):
            break
        for m in members:
            docs, impact = shard.postings(terms[m])
            at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
            score[alive] += np.where(docs[at] == alive, impact[at], 0) * times[m]
    alive = alive[(score[alive] >= threshold) & (score[alive] > 0)]
    return shard.ids[alive], score[alive], tried


def found_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def search(table: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], words: int, labels: list, kind: T.DataType, most: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of every task for every query."""
    context = table.sparkSession.sparkContext
    held = context.broadcast([(p.tolist(), c.tolist()) for p, c in queries])
    schema, item_kind = found_schema(kind), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]):
        best: list[list[tuple[int, int]]] = [[] for _ in held.value]  # heaps of (score, -id), worst first
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.slice(k, 1).to_pylist()[0])
                place = np.full(words, -1)
                place[shard.terms] = np.arange(len(shard.terms))
                where = place.tolist()
                for heap, (places, times) in zip(best, held.value):
                    own = [(where[p], c) for p, c in zip(places, times) if where[p] >= 0]
                    if not own:
                        continue
                    threshold = heap[0][0] if len(heap) == most else 1
                    ids, scores, _ = search_shard(shard, [t for t, _ in own], [c for _, c in own], threshold, most)
                    order = np.lexsort((ids, -scores))[:most]
                    for one in zip(scores[order].tolist(), (-ids[order]).tolist()):
                        if len(heap) < most:
                            heapq.heappush(heap, one)
                        elif one > heap[0]:
                            heapq.heapreplace(heap, one)
        rows = [(k, -doc, score) for k, heap in enumerate(best) for score, doc in heap]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array([labels[k] for k in columns[0]], item_kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            names=["item_id", "doc_id", "score"],
        )

    return table.mapInArrow(run, schema)


def rank(documents: DataFrame, benchmark: DataFrame, most: int = 20, id_column: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best documents of every item, from 1.

    Null and empty texts have no terms: such documents are never found and such items find nothing.
    Rows without an id count in the statistics but take no rank. Equal documents are ranked one by
    one; rows that repeat an item's id and text count once, and different texts of one id are
    ranked together. Other columns are left out; an empty table on either side gives no rows.
    """
    index = build_index(documents, id_column)
    count, length = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    kind, found = benchmark.schema[item_id].dataType, None
    for block in query_blocks(benchmark, item_id) if length else ():
        words, queries = query_words([text for _, text in block])
        holders = document_counts(index, words)
        weights = weights_of(count, holders)
        table = impacts(index, words, weights, paired(queries, weights, holders), count, length)
        part = search(table, queries, len(words), [item for item, _ in block], kind, most)
        found = part if found is None else found.union(part)
    if found is None:
        found = documents.sparkSession.createDataFrame([], found_schema(kind))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")
