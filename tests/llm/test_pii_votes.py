"""Personal data: base spans against the plain patterns, added spans on planted texts."""

import hashlib
import random
import re

import numpy as np

from changeloom.llm import pii_votes, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(digits[::-1])]
    return sum(sum(map(int, str(x))) for x in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and checksum(digits), "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]
            if good():
                out.append((kind, *m.span()))
    return out


def card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + d for d in "0123456789" if checksum(body + d))


def noise(rng):
    pieces = ["a.b@c", "@x.y", "q@w.e.r", "@@", "..@a.b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.004", "+1 (2) 3", "+12345678", "+1 " + "2" * 20, "- ", "é", "12 34-5", "+", ".", "-9", "x1", "\n", "%a+b@k-l.m_n", card(rng), card(rng, 19), card(rng)[:8] + "-" + card(rng)[8:]]
    return "".join(rng.choice(pieces) + rng.choice(["", " ", " ", "x"]) for _ in range(rng.randint(1, 12)))


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "@", "a" * 200_000, "1" * 5_000, "1 " * 5_000 + "@", "+1" + " " * 5_000] + [noise(rng) for _ in range(600)]
    rows = [(k if k % 50 else None, t, "x", 3) for k, t in enumerate(texts)] + [(7, texts[20], "x", 3)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_ip int").repartition(3)
    found = pii_votes.find(frame, pii_votes.Model(None, 0.8, {})).collect()
    key = lambda k, spans: (k if k is not None else -1, sorted(spans))
    got = sorted(key(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in found)
    assert got == sorted(key(r[0], plain_spans(r[1] or "")) for r in rows)


def corpus(seed):
    """Texts with spans of wider forms, and look-alikes that are none."""
    rng = random.Random(seed)
    words = "tree river stone light quiet market winter road garden letter".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    person = lambda: f"{rng.choice(pii_votes.FIRST_NAMES)} {rng.choice(['Baker', 'Miller', 'Dubois', 'Keller'])}"
    good = [
        lambda: ("email", "contact mail ", f"{rng.choice(words)}{digits(2)} [at] {rng.choice(words)} [dot] org"),
        lambda: ("phone", "please call ", f"({digits(3)}) {digits(3)}-{digits(4)}"),
        lambda: ("name", "signed ", person()),
        lambda: ("number", "social security ", f"{digits(3)}-{digits(2)}-{digits(4)}"),
        lambda: ("birth", "she was born ", f"{rng.randint(1, 12):02}/{rng.randint(1, 12):02}/19{digits(2)}"),
        lambda: ("email", "write ", f"{rng.choice(words)}@{rng.choice(words)}.com"),
        lambda: ("phone", "tel ", f"+49 {digits(3)} {digits(7)}"),
        lambda: ("ip", "host ", ".".join(str(rng.randint(11, 250)) for _ in range(4))),
        lambda: ("card", "credit card ", card(rng)),
    ]
    bad = [lambda: f"order {digits(3)}.{digits(3)}.{digits(4)}", lambda: f"version 9.{digits(1)}.{digits(1)}.400", lambda: f"ticket {digits(16)}", lambda: f"serial a{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"release 2031-19-{digits(2)}"]
    rows, planted = [], []
    for k in range(900):
        if rng.random() < 0.6:
            kind, lead, piece = rng.choice(good)()
            text = f"{say(5)} {lead}"
            planted.append((k, kind, len(text), len(text) + len(piece)))
            text += f"{piece} {say(4)}"
        else:
            text = f"{say(5)} {rng.choice(bad)()} {say(4)}"
        rows.append((k, text))
    return rows, planted


def test_wider_forms_are_found_and_look_alikes_left(spark):
    rows, _ = corpus(1)
    model = pii_votes.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    held, planted = corpus(2)
    frame = spark.createDataFrame(held, "doc_id long, text string").repartition(3)
    spans = {(r.doc_id, s.kind, s.start, s.end, s.base) for r in pii_votes.find(frame, model).collect() for s in r.spans}
    found, wanted = {x[:4] for x in spans}, set(planted)
    assert {x[:4] for x in spans if x[4]} == {(k, *s) for k, t in held for s in plain_spans(t)}
    added, asked = {x[:4] for x in spans if not x[4]}, {x for x in wanted if x not in {y[:4] for y in spans if y[4]}}
    assert len(added & asked) >= 0.95 * len(asked) and len(added & asked) >= 0.95 * len(added), (len(added), len(asked), len(added & asked))
    assert {x[1] for x in added} >= {"email", "phone", "name", "number", "birth"} and len(found & wanted) >= 0.97 * len(wanted)
    masked = {r.doc_id: r.text for r in pii_votes.mask(frame, model).collect()}
    key, kind, a, b = next(x for x in sorted(wanted & found))
    assert masked[key] == held[key][1][:a] + f"<{kind}>" + held[key][1][b:]


def test_estimate_finds_the_reliable_labelers():
    rng = np.random.default_rng(6)
    truth = rng.random(6_000) < 0.4
    quality = [0.95, 0.9, 0.85, 0.8, 0.5, 0.75, 0.5]
    said = np.stack([np.where(rng.random(6_000) < q, truth, ~truth) for q in quality], 1).astype(int) * 2
    codes = (said * 3 ** np.arange(7)).sum(1)
    counts = {(1, int(c)): int(n) for c, n in zip(*np.unique(codes, return_counts=True))}
    chance = pii_votes.estimate(counts)
    guess = np.array([chance[1, int(c)] for c in codes]) > 0.5
    majority = said.sum(1) > 7
    assert (guess == truth).mean() > max(0.95, (majority == truth).mean())
    assert pii_votes.estimate({}) == {}


def test_query_and_empty_table(spark, tmp_path):
    rows = [(1, "mail a.b@c.de or 10.20.30.40 and a.b@c.de"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op12_pii_votes(spark, str(tmp_path)).collect()}
    base = "email:5:13,email:33:41,ip:17:28"
    assert (found[1].n_email, found[1].n_ip, found[1].n_card, found[1].n_phone, found[1].spans) == (2, 1, 0, 0, base)
    assert found[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert all(found[k].spans == "" and found[k].base_sha256 == hashlib.sha256(b"").hexdigest() for k in (2, 3))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii_votes.find(empty, pii_votes.learn(empty)).count() == 0
