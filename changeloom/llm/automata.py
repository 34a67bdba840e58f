"""Secret scan by grammar inference.

The base patterns label credentials of three kinds. From a bounded sample of them a probabilistic
automaton is inferred per kind: a string is its frequent literal prefix, letter by letter, and then
one symbol per letter that names the set of letter classes of its rest. States of the prefix tree
merge while the frequencies of their ends and next symbols are statistically compatible, so lengths
stay apart where the samples keep them apart, and become loops where they vary. All other
candidates in all texts are scored by how much likelier a format makes the whole string, its end
included, than ordinary text does; a step or an end that the automaton never saw rejects.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.worker import BLOCK, slices, word_spans
from changeloom.sources.shared import materialize

# The base patterns, their least lengths, and the order of kinds.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "format")
CANDIDATE = r"[A-Za-z0-9+/_.=-]{8,}"
LETTERS = "afAF0+/_.=-"
ALPHABET = len(LETTERS) + 1  # the last class is any other byte
SIZES = (6, 20, 6, 20, 10, 1, 1, 1, 1, 1, 1)  # letters in each class
SHORTEST = 8  # letters of a candidate
LONGEST = 256  # symbols up to which lengths count
PREFIXES = range(2, 17)  # lengths of literal prefixes
RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def symbol(char: str) -> int:
    """Class of a letter: hexadecimal or other, lower or upper, digit, or the sign itself."""
    if "a" <= char <= "z":
        return 0 if char <= "f" else 1
    if "A" <= char <= "Z":
        return 2 if char <= "F" else 3
    return 4 if char.isdigit() else LETTERS.index(char)


@dataclass
class State:
    """Numbers of strings that end here, and of those that go on by each symbol."""

    ends: int = 0
    counts: dict[int, int] = field(default_factory=dict)
    goes: dict[int, int] = field(default_factory=dict)

    def total(self) -> int:
        return self.ends + sum(self.counts.values())


def signature(text: str) -> int:
    """The set of letter classes of a text, as bits; letters beyond f bring the hexadecimal ones along."""
    out = 0
    for c in set(text):
        out |= 1 << symbol(c)
    return closed(out)


def closed(sign: int) -> int:
    return sign | (sign & 0b1010) >> 1


def frequent_prefixes(strings: list[str], least: int = 10, share: float = 0.05) -> frozenset[str]:
    """Literal beginnings that many of the strings have, in front of a rest."""
    counts = Counter(s[:n] for s in strings for n in PREFIXES if n < len(s))
    return frozenset(p for p, n in counts.items() if n >= max(least, share * len(strings)))


def steps(text: str, prefixes: frozenset[str]) -> tuple[list, str]:
    """Symbols of a string, and its rest behind the longest frequent prefix."""
    cut = max((n for n in PREFIXES if n < len(text) and text[:n] in prefixes), default=0)
    rest = text[cut:]
    return [*text[:cut], *[signature(rest)] * min(len(rest), LONGEST)], rest


def differ(a: int, n: int, b: int, m: int, bound: float) -> bool:
    """Whether two frequencies differ by more than their Hoeffding bounds."""
    return abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def infer(strings: list[list], alpha: float = 0.05) -> list[State]:
    """States of an automaton merged from the prefix tree of the strings; state 0 is the start."""
    states = [State()]
    for string in strings:
        at = 0
        for s in string:
            here = states[at]
            here.counts[s] = here.counts.get(s, 0) + 1
            if s not in here.goes:
                here.goes[s] = len(states)
                states.append(State())
            at = here.goes[s]
        states[at].ends += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            a, b = states[p], states[q]
            n, m = a.total(), b.total()
            if not n or not m:
                continue
            if differ(a.ends, n, b.ends, m, bound):
                return False
            for s in a.counts.keys() | b.counts.keys():
                if differ(a.counts.get(s, 0), n, b.counts.get(s, 0), m, bound):
                    return False
                if s in a.goes and s in b.goes:
                    stack.append((a.goes[s], b.goes[s]))
        return True

    def absorb(p: int, q: int) -> None:
        """Add the tree below ``q`` to ``p``."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            a, b = states[p], states[q]
            a.ends += b.ends
            for s, n in b.counts.items():
                a.counts[s] = a.counts.get(s, 0) + n
                if s in a.goes:
                    stack.append((a.goes[s], b.goes[s]))
                else:
                    a.goes[s] = b.goes[s]

    settled, queue = [0], [(0, s) for s in sorted(states[0].goes, key=str)]
    while queue:
        parent, s = queue.pop(0)
        new = states[parent].goes[s]
        if new in settled:
            continue
        for old in settled:
            if compatible(old, new):
                states[parent].goes[s] = old
                absorb(old, new)
                queue = [(p, x) for p in settled for x in sorted(states[p].goes, key=str) if states[p].goes[x] not in settled]
                break
        else:
            settled.append(new)
            queue.extend((new, x) for x in sorted(states[new].goes, key=str))
    number = {old: k for k, old in enumerate(settled)}
    return [State(states[q].ends, states[q].counts, {s: number[t] for s, t in states[q].goes.items() if t in number}) for q in settled]


@dataclass(frozen=True)
class Format:
    """One kind's automaton as logarithms: per state of its symbols, its end, and its next states."""

    states: list[tuple[dict, float | None, dict]]
    prefixes: frozenset[str]
    letters: dict[int, list[float]]
    signatures: frozenset[int]


@dataclass(frozen=True)
class Formats:
    """Formats by kind, log-frequencies of letter classes behind each other in ordinary text, and the
    verdict's threshold."""

    automata: dict[str, Format]
    ordinary: list[list[float]]
    threshold: float = 12.0


def format_of(strings: list[str]) -> Format:
    """The format of some credentials; the letters behind the prefixes count by class."""
    prefixes = frequent_prefixes(strings)
    split = [steps(s, prefixes) for s in strings]
    states = []
    for state in infer([x for x, _ in sorted(split, key=lambda x: x[1])]):
        total = state.total()
        states.append(({s: math.log(n / total) for s, n in state.counts.items()}, math.log(state.ends / total) if state.ends else None, state.goes))
    letters: dict[int, list[float]] = {}
    for _, rest in split:
        counts = letters.setdefault(signature(rest), [0.0] * len(SIZES))
        for c in rest:
            counts[symbol(c)] += 1
    for sign, counts in letters.items():
        letters[sign] = [math.log(n / sum(counts)) - math.log(size) if n else 0.0 for n, size in zip(counts, SIZES)]
    return Format(states, prefixes, letters, frozenset(map(signature, strings)))


def likelihood(text: str, form: Format) -> float:
    """Log-probability of the whole string; minus infinity beside the automaton's steps and ends."""
    if signature(text) not in form.signatures:
        return -math.inf
    path, rest = steps(text, form.prefixes)
    letters = form.letters.get(signature(rest))
    if letters is None:
        return -math.inf
    at, total = 0, 0.0
    for s in path:
        logs, _, goes = form.states[at]
        if s not in logs or s not in goes:
            return -math.inf
        total += logs[s]
        at = goes[s]
    end = form.states[at][1]
    return -math.inf if end is None else total + end + sum(letters[symbol(c)] for c in rest)


def gain(text: str, formats: Formats) -> float:
    """How much likelier the best format makes the text than ordinary text does."""
    best = max((likelihood(text, a) for a in formats.automata.values()), default=-math.inf)
    if best == -math.inf:
        return best
    return best - ordinary(text, formats.ordinary)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret) of the base patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), m.end(), "assign", m[2]) for m in re.finditer(ASSIGN, text) if len(m[2]) >= LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [(m.start(), m.end(), kind, m[0]) for m in re.finditer(pattern, text) if m.end() - m.start() >= LEAST[kind]]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def pieces(word: str, start: int) -> Iterator[tuple[int, str]]:
    """A run of letters without signs at its ends, and its parts between signs of equality."""
    bare = word.strip(".=-")
    yield start + word.index(bare), bare
    if "=" in bare:
        for m in re.finditer("[^=]+", word):
            part = m[0].strip(".-")
            yield start + m.start() + m[0].index(part), part


def added_spans(text: str, base: list[tuple[int, int, str, str]], formats: Formats) -> list[tuple[int, int, str, str]]:
    """Candidates outside the base spans that a format explains; also beside one in the same run."""
    signs = frozenset().union(*(f.signatures for f in formats.automata.values())) if formats.automata else frozenset()
    out, last = [], 0
    taken = sorted((a, b) for a, b, _, _ in base)
    for m in re.finditer(CANDIDATE, text) if signs else ():
        free, at = [], m.start()
        while last < len(taken) and taken[last][1] <= m.start():
            last += 1
        for a, b in taken[last:]:
            if a >= m.end():
                break
            free.append((at, a))
            at = max(at, b)
        free.append((at, m.end()))
        for a, b in free:
            for place, word in pieces(text[a:b], a) if b - a >= SHORTEST else ():
                if len(word) >= SHORTEST and signature(word) in signs and gain(word, formats) >= formats.threshold:
                    out.append((place, place + len(word), "format", word))
                    break
    return out


def class_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
    return table


def interesting(column: pa.Array, signs: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows with a run of 16 letters of any secret, with a shorter one of the given letter classes,
    or with a keyword."""
    table = class_table()
    bits = np.array([1 << symbol(chr(b)) if table[b] else 0 for b in range(256)], np.uint16)
    edges = [1 << LETTERS.index(c) for c in ".=-"]
    wanted = np.zeros(1 << len(LETTERS), bool)  # signs at the ends of a run may go
    for sign in signs:
        for k in range(8):
            wanted[sign | sum(e for n, e in enumerate(edges) if k >> n & 1)] = True
    wanted = wanted[[closed(k) for k in range(len(wanted))]]
    equal = np.uint16(1 << LETTERS.index("="))
    for first, last, data, offsets in slices(column):
        starts, ends, rows = word_spans(data, offsets, table)
        flag = np.zeros(last - first, bool)
        size = ends - starts
        flag[rows[size >= 16]] = True
        if len(signs) and len(starts):
            long = np.flatnonzero(size >= SHORTEST)
            found = np.bitwise_or.reduceat(bits[data], starts)[long]
            flag[rows[long[wanted[found] | ((found & equal) > 0)]]] = True
        lowered = data.tobytes().lower()
        for k in np.flatnonzero(~flag).tolist():
            part = lowered[offsets[k]:offsets[k + 1]]
            flag[k] = any(word in part for word in KEYWORDS)
        yield first, last, flag


def labelled(documents: DataFrame, most: int = 2_000) -> dict[str, list[str]]:
    """Distinct secrets by kind, at most ``most`` of each, chosen by the smallest hash."""

    def run(batches):
        for batch in batches:
            kinds, secrets = [], []
            for first, last, flag in interesting(batch.column("text")):
                for text, wanted in zip(batch.column("text")[first:last], flag):
                    if wanted:
                        for _, _, kind, secret in base_spans(text.as_py() or ""):
                            kinds.append(kind)
                            secrets.append(secret)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(secrets, pa.string())], names=["kind", "secret"])

    spans = documents.selectExpr("cast(text as string) text").mapInArrow(run, "kind string, secret string").distinct()
    ranked = spans.withColumn("order", F.xxhash64("secret"))
    ranked = materialize(ranked, "labelled-secrets")
    firsts = {k: ranked.where(F.col("kind") == k).orderBy("order", "secret").limit(most) for k in KINDS[:3]}
    found = {kind: [r.secret for r in rows.collect()] for kind, rows in firsts.items()}
    return {kind: secrets for kind, secrets in found.items() if secrets}


def ordinary_text(documents: DataFrame) -> list[list[float]]:
    """Log-frequencies of a letter's class behind each class, in all texts; the last class is any
    other byte, and the beginning of a text."""
    names = [f"n{s}" for s in range(ALPHABET * ALPHABET)]

    def count(batches):
        table = class_table()
        kinds = np.array([symbol(chr(b)) if table[b] else ALPHABET - 1 for b in range(256)], np.int64)
        total = np.zeros(ALPHABET * ALPHABET, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                begins = offsets[:-1]
                for at in range(0, len(data), BLOCK):
                    part = kinds[data[at:at + BLOCK]]
                    before = np.concatenate(([ALPHABET - 1 if at == 0 else kinds[data[at - 1]]], part[:-1]))
                    before[begins[(begins >= at) & (begins < at + len(part))] - at] = ALPHABET - 1
                    total += np.bincount(before * ALPHABET + part, minlength=ALPHABET * ALPHABET)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in total.tolist()], names=names)

    sums = documents.selectExpr("cast(text as string) text").mapInArrow(count, ", ".join(f"{n} long" for n in names))
    counts = np.array([n or 0 for n in sums.agg(*[F.sum(n) for n in names]).first()]).reshape(ALPHABET, ALPHABET) + 1
    return np.log(counts / counts.sum(1, keepdims=True)).tolist()


def ordinary(text: str, logs: list[list[float]]) -> float:
    """Log-probability of a run of letters, between others, in ordinary text."""
    total, before = 0.0, ALPHABET - 1
    for c in text:
        here = symbol(c)
        total += logs[before][here] - math.log(SIZES[here])
        before = here
    return total + logs[before][ALPHABET - 1]


def learn(documents: DataFrame, most: int = 2_000, threshold: float = 12.0) -> Formats:
    """Formats of the credentials that the base patterns find; none when they find none."""
    found = labelled(documents, most)
    automata = {kind: format_of(secrets) for kind, secrets in found.items()}
    return Formats(automata, ordinary_text(documents), threshold)


def joined(spans: list[tuple[int, int, str, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans)


def scan(documents: DataFrame, formats: Formats, id_column: str = "doc_id") -> DataFrame:
    """Spans of every row, in code points. Null and empty texts have none; ids may repeat or be null."""
    nothing = hashlib.sha256(b"").hexdigest()
    signs = frozenset().union(*(f.signatures for f in formats.automata.values())) if formats.automata else frozenset()

    def run(batches):
        for batch in batches:
            counts, digests, all_spans = {k: [] for k in KINDS[:3]}, [], []
            for first, last, flag in interesting(batch.column("text"), signs):
                for text, wanted in zip(batch.column("text")[first:last], flag):
                    if not wanted:
                        for kind in counts:
                            counts[kind].append(0)
                        digests.append(nothing)
                        all_spans.append("")
                        continue
                    text = text.as_py() or ""
                    base = base_spans(text)
                    more = added_spans(text, base, formats)
                    for kind in counts:
                        counts[kind].append(sum(x[2] == kind for x in base))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    all_spans.append(joined(sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))))
            columns = [pa.array(v, pa.int64()) for v in counts.values()] + [pa.array(digests, pa.string()), pa.array(all_spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *columns], names=[id_column, *(f.split()[0] for f in RESULT.split(", "))])

    source = documents.selectExpr(f"cast(`{id_column}` as long) `{id_column}`", "cast(text as string) text")
    return source.mapInArrow(run, f"`{id_column}` long, {RESULT}")
