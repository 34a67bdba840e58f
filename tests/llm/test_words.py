"""Words that simple polynomial hashes confuse, in every operator that compares words by hash."""

import tracemalloc

import numpy as np
from tokenizers import Tokenizer

from changeloom.llm import fertility, line_join, odd_minhash, queries, token_store, winnow, worker

# Two words of 1,024 letters: a or b by the parity of the place's bits, and the complement.
ONE = "".join("ab"[k.bit_count() % 2] for k in range(1_024))
TWO = "".join("ba"[k.bit_count() % 2] for k in range(1_024))


def documents_of(spark):
    return spark.createDataFrame([(0, ONE), (1, TWO), (2, f"{ONE} {TWO}")], "doc_id long, text string").coalesce(1)


def test_token_store_tells_them_apart(spark):
    tokenizer = Tokenizer.from_file(queries.WORD_VOCABULARY)
    _, manifest = token_store.write_store(documents_of(spark), queries.WORD_VOCABULARY, queries.WORD_END)
    found = {r.doc_id: r.n_tokens for r in token_store.read_store(manifest).collect()}
    assert found == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate([ONE, TWO, f"{ONE} {TWO}"])}


def test_near_duplicates_lines_and_windows_tell_them_apart(spark):
    documents = documents_of(spark)
    near = {r.doc_id: r.component_id for r in odd_minhash.near_duplicates(documents, n=3, percent=85).collect()}
    assert near == {0: 0, 1: 1, 2: 2}
    assert all(r.n_removed == 0 for r in line_join.line_report(documents).collect())
    benchmark = spark.createDataFrame([(7, ONE)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in winnow.contamination(documents, benchmark).collect()} == {0: 1, 1: 0, 2: 1}
    assert [r.n_repeat_words for r in fertility.score(documents, queries.PIECE_MODEL).collect()] == [0, 0, 0]


def test_words_of_one_hash_are_encoded_apart(monkeypatch):
    texts = ["some longer words meet", "other stretched terms come", "some longer phrases differ"]
    monkeypatch.setattr(token_store, "span_hashes", lambda data, starts, ends: np.where(ends - starts > 5, 7, (starts * 0 + ends - starts)).astype(np.uint64))
    codec = token_store.WordCodec(lambda words: [list(w.encode()) for w in words], 256)
    for _ in range(2):  # the second time against what it remembers
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.cumsum([0] + [len(t) for t in texts])
        ids, bounds = codec.encode(data, offsets)
        assert [bytes(ids[a:b].tolist()).decode() for a, b in zip(bounds, bounds[1:])] == [t.replace(" ", "") for t in texts]


def test_hashes_follow_the_bytes_alone():
    rng = np.random.default_rng(3)
    words = [rng.integers(97, 99, n).astype(np.uint8) for n in (0, 1, 7, 8, 9, 16, 17, 1_024, 1_025, 3_000) for _ in range(40)]
    data = np.concatenate(words)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    hashes = worker.span_hashes(data, starts, ends)
    alone = [worker.span_hashes(w, np.array([0]), np.array([len(w)]))[0] for w in words]
    assert hashes.tolist() == [int(x) for x in alone]
    assert len(set(hashes.tolist())) == len({w.tobytes() for w in words})


def test_codec_remembers_many_words_in_little_memory():
    codec = token_store.WordCodec(lambda words: [list(w.encode()) for w in words], 256)
    tracemalloc.start()
    for turn in (0, 1, 2, 0):  # the last time against what it remembers
        words = [b"%d" % (k * 7 + turn) for k in range(100_000)]
        data = np.frombuffer(b" ".join(words), np.uint8)
        ids, bounds = codec.encode(data, np.array([0, len(data)]))
        assert bytes(ids.astype(np.uint8)) == b"".join(words) and bounds.tolist() == [0, len(ids)]
        del words, data, ids, bounds
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert codec.words == 300_000 and held < 100 * codec.words
