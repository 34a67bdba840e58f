"""Secret formats: base spans against the plain patterns, learned automata, planted secrets."""

import random
import re

import pytest

from changeloom.llm import automata

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def plain_base(text):
    """The base patterns read word by word, without the module's regular expressions."""
    found = []
    at = 0
    keyword = re.compile("password|passwd|secret|token|api_key|apikey", re.I | re.A)
    while m := keyword.search(text, at):
        k = m.end()
        k += text[k:k + 1] in ("'", '"') and text[k:k + 1] != ""
        while text[k:k + 1] == " ":
            k += 1
        if text[k:k + 1] not in (":", "=") or not text[k:k + 1]:
            at = m.start() + 1
            continue
        k += 1
        while text[k:k + 1] == " ":
            k += 1
        k += text[k:k + 1] in ("'", '"') and text[k:k + 1] != ""
        end = k
        while end < len(text) and text[end] in LOWER + UPPER + DIGITS + "+/_.=-":
            end += 1
        if end == k:
            at = m.start() + 1
            continue
        if end - k >= 8:
            found.append((m.start(), end, "assign"))
        at = end
    for kind, start, letters, least in (("access", "AKIA", UPPER + DIGITS, 16), ("hex", "", "abcdef" + DIGITS, 32)):
        at = 0
        while at < len(text):
            if not text.startswith(start, at) or text[at + len(start):at + len(start) + 1] not in set(letters):
                at += 1
                continue
            end = at + len(start)
            while end < len(text) and text[end] in letters:
                end += 1
            if end - at >= least:
                found.append((at, end, kind))
            at = end
    return sorted(found, key=lambda x: (x[0], automata.KINDS.index(x[2])))


def test_base_spans_equal_a_plain_reading():
    rng = random.Random(3)
    pieces = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", '"', "'", " ", "=", ":", "  ", "abc", "abcdefgh", "0123456789abcdef" * 2, "AKIA", "AKIA" + "Q7" * 7, "x.y-z_w/+", "é", "\n", "passwordtoken"]
    for _ in range(4_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert [x[:3] for x in automata.base_spans(text)] == plain_base(text), text


def credential(rng):
    say = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return rng.choice([
        lambda: "sk_live_" + say(LOWER + UPPER + DIGITS, 24), lambda: "ghp_" + say(LOWER + UPPER + DIGITS, 36),
        lambda: say("0123456789abcdef", 40), lambda: say(LOWER + UPPER + DIGITS, rng.randint(12, 20)),
    ])()


ORDINARY = ["user12345678901234", "file_2024_01_02_report", "internationalization", "2024-01-02", "1234567890123456", "CONSTANT_NAME_HERE", "path/to/some/file.txt", "version=1.2.3", "well-known-word", "deadbeef"]


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(5)
    texts = [f'the quick word set token = "{credential(rng)}" and so on with ordinary text around it' for _ in range(600)]
    texts += ["Plain prose without anything in it. The Letters of May 1999 came late. " * 30 + str(k) for k in range(400)]
    return automata.learn(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


def test_automata_keep_prefixes_and_lengths(learned):
    form = learned.automata["assign"]
    assert len(form.states) > 20 and {"sk_live_", "ghp_"} <= form.prefixes
    rng = random.Random(6)
    assert automata.likelihood("sk_live_" + "zQ3" * 8, form) > -float("inf")
    assert automata.likelihood("sk_live_" + "zQ3" * 7, form) == -float("inf")  # no end there
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    assert automata.likelihood(hexes(40), form) > -float("inf") == automata.likelihood(hexes(39), form)


def test_planted_secrets_are_found_and_ordinary_words_left(spark, learned):
    rng = random.Random(7)
    planted = [credential(rng) for _ in range(200)]
    texts = [f"see {x} here." for x in planted] + [f"see {x} here." for x in ORDINARY] + ["a=" + planted[0] + ".", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in automata.scan(frame, learned).collect()}
    hit = [k for k, x in enumerate(planted) if re.search(rf"(format|hex):4:{4 + len(x)}(,|$)", found[k])]
    assert len(hit) >= 0.95 * len(planted)
    assert all(found[200 + k] == "" for k in range(len(ORDINARY)))
    assert f":2:{2 + len(planted[0])}" in found[200 + len(ORDINARY)] and found[201 + len(ORDINARY)] == ""


def test_rest_of_a_run_beside_a_base_span_is_judged(learned):
    secret = "sk_live_" + "Qz7" * 8
    text = "0123456789abcdef" * 2 + "." + secret
    base = automata.base_spans(text)
    assert [x[2] for x in base] == ["hex"]
    assert [x[:3] for x in automata.added_spans(text, base, learned)] == [(33, 33 + len(secret), "format")]
