"""The ten operators against brute force on small tables with nulls, empty and repeated texts."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from tokenizers import Tokenizer

from changeloom.llm import automata, bpe_chunks, fertility, lexicon, line_join, odd_minhash, queries, shards, suffix_dedup, token_store, winnow

WORDS = [a + b for a in "ba do ki lu me no pa ri so tu".split() for b in "la ne po sti vor xa zem".split()]


def make_texts():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [None, "", " \n\t", "one", "Zwei  Wörter", "a" * 3_000, "x y " * 900, "naïve café 日本語 " * 30]
    lines = [say(rng.randint(3, 30)) for _ in range(25)]
    for _ in range(60):
        texts.append("\n".join(rng.choice(lines) if rng.random() < 0.4 else say(rng.randint(1, 40)) for _ in range(rng.randint(1, 6))))
    for text in texts[8:38]:
        words = text.split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += texts[8:14] + [say(20_000)]
    return texts


TEXTS = make_texts()
SCHEMA = "doc_id long, text string, lang string, n_words long, kept boolean, shard int, id string"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, t, None, 7, True, 3, "x") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_chunked_bpe_equals_the_library(documents, nothing):
    encode = lambda d: bpe_chunks.encode_documents(d, queries.BYTE_RANKS, queries.public_tokenizers.PATTERN, queries.BYTE_VOCABULARY, with_ids=True)
    tokenizer, found = library(queries.BYTE_VOCABULARY), by_id(encode(documents))
    for k, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert found[k].ids == ids and found[k].n_tokens == len(ids)
        assert found[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode(nothing).count() == 0


def test_token_store_round_trip(spark, documents, nothing):
    folder, manifest = token_store.write_store(documents, queries.WORD_VOCABULARY, 2, sample=80, dictionary_bytes=2_048)
    tokenizer, found, start = library(queries.WORD_VOCABULARY), by_id(token_store.read_store(manifest, with_ids=True)), 0
    for k, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (found[k].ids, found[k].start, found[k].ids_crc32) == (ids, start, zlib.crc32(raw))
        start += len(ids)
    assert token_store.fetch(spark, manifest, 9).tolist() == found[9].ids and token_store.fetch(spark, manifest, -5) is None
    assert token_store.read_store(token_store.write_store(nothing, queries.WORD_VOCABULARY, 2)[1]).count() == 0


def test_repeated_strings_are_removed(documents, nothing):
    seen, found = {}, by_id(suffix_dedup.repeated_strings(documents))
    for k, text in enumerate(TEXTS):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for at in range(len(raw) - 49):
            if seen.setdefault(raw[at:at + 50], k) < k:
                gone[at:at + 50] = [True] * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert found[k][1:] == (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.repeated_strings(nothing).count() == 0


@pytest.mark.parametrize("n,percent,block", [(3, 85, 32_000), (5, 80, 100)])
def test_near_duplicates(documents, nothing, n, percent, block):
    sets = []
    for text in TEXTS:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    parent = list(range(len(sets)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    found = by_id(odd_minhash.near_duplicates(documents, n, percent, 32, 6, block_shingles=block))
    for k in range(len(sets)):
        assert found[k][1:] == (len(sets[k]), root(k), root(k) == k)
    assert odd_minhash.near_duplicates(nothing).count() == 0


def test_quality_counts(documents, nothing):
    found = by_id(fertility.score(documents, queries.PIECE_MODEL))
    for k, text in enumerate(TEXTS):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert found[k][1:6] == expected
        assert found[k].base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words))
        assert not (found[k].base_failed and found[k].kept)
    kept = {r.doc_id for r in fertility.keep_good(documents, queries.PIECE_MODEL).collect()}
    assert kept == {k for k, r in found.items() if r.kept} and fertility.score(nothing, queries.PIECE_MODEL).count() == 0


def test_marks_between_words_lower_the_entropy(spark):
    rng = random.Random(3)
    prose = [" ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(200)) for _ in range(3)]
    rows = [(2 * k + junk, (" | " if junk else " ").join(text.split()), lang) for k, (text, lang) in enumerate(zip(prose, ("en", None, "?"))) for junk in (0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = by_id(fertility.score(frame, queries.PIECE_MODEL, language_column="lang"))
    for k in range(3):
        assert found[2 * k].kept and not found[2 * k + 1].kept and not found[2 * k + 1].base_failed
    # A text ten times as long, of the same kind, has about the same entropy.
    say = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    sizes = by_id(fertility.score(spark.createDataFrame([(0, say(400)), (1, say(4_000))], "doc_id long, text string"), queries.PIECE_MODEL))
    assert abs(sizes[0].bits - sizes[1].bits) < 0.2
    assert {r.doc_id for r in fertility.keep_good(frame, queries.PIECE_MODEL, language_column="lang").collect()} == {0, 2, 4}


def test_similar_lines(documents, nothing):
    expected, before = set(), []
    for k, text in enumerate(TEXTS):
        for number, line in enumerate((text or "").split("\n")):
            words = set(line.encode().lower().split())
            if not words:
                continue
            if any(100 * len(words & x) >= 80 * len(words | x) for x in before):
                expected.add((k, number))
            before.append(words)
    gone = line_join.similar_lines(documents)
    assert {(r.doc, r.line) for r in gone.collect()} == expected and expected
    left = by_id(line_join.drop_lines(documents, gone))
    for k, text in enumerate(TEXTS):
        whole = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (k, i) not in expected)
        assert left[k].text == whole
    assert line_join.line_report(nothing).count() == 0


def test_sharding(documents, nothing):
    rows = shards.shard_documents(documents, 4, bucket_bytes=4_000).collect()
    assert {r.doc_id: r.text for r in rows} == dict(enumerate(TEXTS)) and len(rows) == len(TEXTS)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    assert shards.shard_documents(nothing, 4).count() == 0


def test_slots_do_not_depend_on_partitions(spark, documents):
    """Rows come twice, some without an id; another number of partitions gives the same slots."""
    more = documents.union(documents.selectExpr("if(doc_id % 3 = 0, null, doc_id)", "* except (doc_id)"))
    seen = []
    for parts in (3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        rows = shards.shard_documents(more.repartition(parts), 4, bucket_bytes=3_000, lane_buckets=2).collect()
        seen.append(sorted(map(repr, rows)))
        for shard in range(4):
            slots = sorted(r.slot for r in rows if r.shard == shard)
            assert slots == list(range(len(slots)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and len(seen[0]) == 2 * len(TEXTS)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert order != sorted(order)


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_winnowing(spark, documents, nothing, block):
    items = [(0, None)]
    long_text = TEXTS[-1].split()
    items += [(1, " ".join(long_text[40:70])), (2, "Zwei  wörter"), (3, "never said before by anyone"), (4, " ".join(long_text[2000:2013]).upper()), (4, "one"), (5, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        words = split(text)
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i:i + size]), set()).add(str(item))
    found = by_id(winnow.contamination(documents, benchmark, block_bytes=block))
    for k, text in enumerate(TEXTS):
        words, hit, names = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    names |= windows[tuple(words[i:i + size])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert found[k][1:] == (len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words))
    left = {r.doc_id for r in winnow.drop_contaminated(documents, benchmark, block_bytes=block).collect()}
    assert left == {k for k, r in found.items() if not r.contaminated}
    assert winnow.contamination(nothing, benchmark).count() == 0
    assert winnow.contamination(documents, benchmark.limit(0)).where("contaminated").count() == 0


def test_lexicon_learns_stems_and_sees_through_disguise(spark, documents, nothing):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        if k % 5 == 0:
            for _ in range(2):
                words[rng.randrange(len(words))] = "grobian" + rng.choice(["", "en", "isch"])
        rows.append((" ".join(words), int(k % 5 == 0)))
    learned = lexicon.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert any(x.startswith("grob") for x in learned.weights)
    cases = spark.createDataFrame([(1, "du Grobian"), (2, "du gr0b1an!"), (3, "du grоbian"), (4, "bala dune"), (5, None), (6, "")], "doc_id long, text string")
    scores = {k: r.score for k, r in by_id(lexicon.score(cases, learned)).items()}
    assert min(scores[1], scores[2], scores[3]) >= 0.7 > max(scores[4], scores[5], scores[6])
    # Forty near copies do not make their words signs; words which go along with others are all learned.
    copies = [(f"{' '.join(rows[0][0].split()[:3])} solus unicus rarus grobian vandal copia {k}", 1) for k in range(40)]
    pairs = [(f"{rng.choice(WORDS)} {rng.choice(WORDS)} vandal grobian {rng.choice(WORDS)} {rng.choice(WORDS)}", 1) for _ in range(60)]
    both = lexicon.learn(spark.createDataFrame(rows + copies + pairs, "text string, toxic int"))
    assert {"grobian", "vandal"} <= both.weights.keys() and not any(x.startswith("unic") for x in both.weights)
    assert lexicon.found_in(lexicon.fold("kill the process"), lexicon.automaton(["kill"], ["kill the process"])) == []
    empty = lexicon.learn(spark.createDataFrame([], "text string, toxic int"))
    assert lexicon.score(documents, empty).where("score >= 0.7").count() == 0 and lexicon.score(nothing, empty).count() == 0


def test_secret_formats(spark, nothing):
    rng = random.Random(4)
    secret = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f'é token = "{secret()}" rest' for _ in range(200)] + ["AKIA" + "A1B2C3D4E5F6", "password: short", "plain words only", None, "", "x" * 40,
             "see " + "g7" + secret(28) + "q"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = by_id(automata.scan(frame, automata.learn(frame)))
    for k, text in enumerate(texts):
        base = automata.base_spans(text or "")
        assert found[k].base_sha256 == hashlib.sha256(automata.joined(base).encode()).hexdigest()
        assert set(filter(None, automata.joined(base).split(","))) <= set(found[k].spans.split(","))
    assert (found[0].n_assign, found[0].n_hex, found[200].n_access, found[201].n_assign) == (1, 1, 1, 0)
    assert found[0].spans.split(",")[0] == "assign:2:51" and found[202].spans == found[203].spans == found[205].spans == ""
    assert automata.scan(nothing, automata.learn(nothing)).count() == 0


def test_automaton_generalises_over_lengths():
    states = automata.infer([[4, 0] * n for n in range(3, 9) for _ in range(20)])
    assert len(states) < 40 and sum(s.ends for s in states) == 120
