"""The corpus pipeline from end to end against plain Python, on the smallest tables with rows added."""

import hashlib
import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from changeloom.llm import queries

DATA = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def base_failed(text):
    words = SPACE.findall(text or "")
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k:k + 8]), []).append(k)
    repeated = {k + j for ks in places.values() if len(ks) > 1 for k in ks for j in range(8)}
    return len(words) < 20 or 100 * len(repeated) > 30 * len(words)


def without_similar_lines(texts):
    seen, left = {}, {}
    for doc in sorted(texts):
        lines = []
        for line in texts[doc].split("\n"):
            words = frozenset(line.encode().lower().split())
            if words and words not in seen:
                size = len(words)
                seen[words] = any(100 * len(words & x) >= 80 * len(words | x) for x in seen if 0.8 * size <= len(x) <= 1.25 * size)
                gone = seen[words]
            else:
                gone = bool(words)
            if not gone:
                lines.append(line)
        left[doc] = "\n".join(lines) if lines else None
    return left


def first_of_near_copies(texts):
    sets = {}
    for doc, text in texts.items():
        words = SPACE.findall(lower(text or ""))
        sets[doc] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    least = {doc: doc for doc in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in pairs:  # at most as many rounds as links
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    return {doc: text for doc, text in texts.items() if least[doc] == doc}


def uncontaminated(texts, items):
    windows = set()
    for item in items:
        words = LETTERS.findall(lower(item or ""))
        n = min(13, len(words))
        windows |= {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if words else set()
    lengths = {len(w) for w in windows}
    kept = {}
    for doc, text in texts.items():
        words = LETTERS.findall(lower(text or ""))
        hit = {k + j for n in lengths for k in range(len(words) - n + 1) if tuple(words[k:k + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(words):
            kept[doc] = text
    return kept


def test_equals_plain_python(spark, tmp_path):
    documents = pq.read_table(f"{DATA}/documents.parquet")
    rows = documents.to_pylist()
    last = max(r["doc_id"] for r in rows)
    longest = max(rows, key=lambda r: len(r["text"] or ""))
    rows += [longest | {"doc_id": last + 1, "text": None}, longest | {"doc_id": last + 2, "text": ""}, longest | {"doc_id": last + 3}]
    pq.write_table(pa.Table.from_pylist(rows, documents.schema), tmp_path / "documents.parquet")
    for name in ("benchmark", "labels"):
        pq.write_table(pq.read_table(f"{DATA}/{name}.parquet"), tmp_path / f"{name}.parquet")
    texts = {r["doc_id"]: r["text"] for r in rows}

    frame = queries.table(spark, str(tmp_path), "documents")
    good = {r.doc_id for r in corpus_pipeline.quality(spark, frame, str(tmp_path)).collect()}
    passed = {doc for doc, text in texts.items() if not base_failed(text)}
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    assert good <= passed and all(quality.get(doc) != 1 for doc in passed - good)

    left = without_similar_lines({doc: texts[doc] for doc in good})
    one = first_of_near_copies(left)
    clean = uncontaminated(one, pq.read_table(f"{DATA}/benchmark.parquet")["text"].to_pylist())
    assert len(texts) > len(good) and any(left[doc] != texts[doc] for doc in good) and len(one) > len(clean) > 50
    tokenizer = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    expected = {}
    for doc, text in clean.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(k.to_bytes(4, "little") for k in ids)
        told = tokenizer.decode(ids, skip_special_tokens=False).encode()
        expected[doc] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(told).hexdigest())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(expected)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == expected
