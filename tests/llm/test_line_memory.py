"""Tasks of the line join hold little, however many lines and pairs there are."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from changeloom.llm import line_join, worker


class Batches:
    """Stands for a DataFrame of pieces, to run what it would run in a task."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return list(run(iter(self.batches)))

    def repartition(self, *keys):
        return self

    sortWithinPartitions = repartition


def peak_mb(call):
    tracemalloc.start()
    out = call()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def words(rng, n, vocabulary):
    return [f"w{k}" for k in rng.sample(range(vocabulary), n)]


def test_entries_are_held_as_numbers_of_their_lines():
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{k:04d}" for k in range(6_000)])
    texts = ["\n".join(" ".join(vocabulary[rng.integers(0, 6_000, 60)]) for _ in range(100)) for _ in range(700)]
    batch = pa.record_batch({"id": pa.array(range(700), pa.int64()), "text": pa.array(texts)})

    class Classes:
        value = np.full(1 << line_join.TABLE_BITS, 10, np.uint8)

    found, most = peak_mb(lambda: line_join.index_lines(Batches(batch), Classes, 80, 1, 64))
    assert sum(len(one) for one in found) == 64 and most < 110


def test_pairs_of_one_word_are_reduced_as_they_come():
    n = 2_500  # 3.1 million pairs
    entries = np.zeros(n, line_join.ENTRY)
    entries["token"], entries["size"], entries["doc"], entries["line"] = 7, 10, 1, np.arange(n)
    (ends, heads), most = peak_mb(lambda: line_join.similar_stars(entries, 80))
    assert (ends == np.arange(n)).all() and (heads == 0).all() and most < 40


def test_long_lines_are_no_candidates_unless_alike(spark, monkeypatch):
    """Lines of all bitmap sizes; only lines with a common copy reach the exact check."""
    rng = random.Random(12)
    lines = [words(rng, n, 4_000) for n in (70, 150, 200, 340, 400, 480, 600, 700) for _ in range(25)]
    copies = []
    for line in lines[::10]:
        for share in (0.02, 0.08, 0.12, 0.2):
            other = list(line)
            for k in rng.sample(range(len(other)), int(share * len(other))):
                other[k] = f"x{rng.randrange(10 ** 6)}"
            copies.append(other[:rng.randint(9 * len(other) // 10, len(other))])
    every = [*lines, *copies]
    expected = set()
    for k, one in enumerate(every):
        if any(100 * len(set(one) & set(x)) >= 80 * len(set(one) | set(x)) for x in every[:k]):
            expected.add((k, 0))
    placed = []
    wanted = line_join.wanted_lines
    monkeypatch.setattr(line_join, "wanted_lines", lambda documents, places: placed.append(places.count()) or wanted(documents, places))
    frame = spark.createDataFrame([(k, " ".join(line)) for k, line in enumerate(every)], "doc_id long, text string").repartition(4)
    assert {(r.doc, r.line) for r in line_join.similar_lines(frame).collect()} == expected and len(expected) > 20
    assert placed[0] <= len(copies) + len(lines[::10])


def test_tokens_of_a_bucket_are_matched_some_at_a_time(spark, monkeypatch):
    rng = random.Random(13)
    texts = ["\n".join(" ".join(words(rng, 6, 12)) for _ in range(8)) for _ in range(60)]
    entries = []
    match = line_join.similar_stars
    monkeypatch.setattr(line_join, "MATCH_ENTRIES", 100)
    monkeypatch.setattr(line_join, "similar_stars", lambda found, percent: entries.append(len(found)) or match(found, percent))
    batch = pa.record_batch({"id": pa.array(range(60), pa.int64()), "text": pa.array(texts)})

    class Classes:
        value = np.full(1 << line_join.TABLE_BITS, 10, np.uint8)

    edges = lambda pieces: {(r["a"]["doc"], r["a"]["line"], r["removed"]) for one in pieces for r in one.to_pylist()}
    packed = line_join.index_lines(Batches(batch), Classes, 80, 1, 1)
    some = edges(line_join.match_entries(Batches(*packed), 80))
    assert len(entries) > 3 and max(entries) < 1_000
    monkeypatch.setattr(line_join, "MATCH_ENTRIES", 10 ** 9)
    assert edges(line_join.match_entries(Batches(*packed), 80)) == some and some


def test_a_task_gives_up_what_other_operators_kept():
    worker.keep("test:vocabulary", lambda: np.zeros(10))
    empty = pa.record_batch({"bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
    assert line_join.match_entries(Batches(empty), 80) == []
    assert worker.keep("test:vocabulary", lambda: "built again") == "built again"
    worker.release()


def test_line_dedup_drops_the_vocabulary_of_the_stage_before(spark):
    """Worker processes of a pipeline's stage are used again by the next one."""
    source = pa.record_batch({"id": pa.array([1], pa.int64()), "text": pa.array(["to be or not"])})

    class Classes:
        value = np.full(1 << line_join.TABLE_BITS, 10, np.uint8)

    worker.keep("test:vocabulary", lambda: "of the quality rules")
    assert len(line_join.index_lines(Batches(source), Classes, 80, 1, 64)) == 1
    assert worker.keep("test:vocabulary", lambda: "built again") == "built again"
    worker.release()
