"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs and digit substitutions to Latin letters,
punctuation to spaces. Entries are beginnings of words, so one pass finds them with their
inflections. Exception phrases take back the hits inside them. The sum of the weights is divided
by the logarithm of the length and goes through a logistic curve.

Lexicon, exceptions and curve are learned from a bounded sample of labelled texts (the bound is a
parameter): entries are the word beginnings that are nearly always a sign of a toxic text, and
those that explain the toxic texts without one. Every text is scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.llm.worker import keep
from changeloom.sources.shared import materialize

# Look-alike letters and what they are read as; digits and signs used as letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "χ": "x",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
SHORTEST, LONGEST = 3, 12


@dataclass(frozen=True)
class Lexicon:
    """Weights of word beginnings, phrases that are no hits, and the curve's slope and offset."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    offset: float = -1.0


def _byte_table() -> bytes:
    table = bytearray(range(128))
    for code in range(128):
        char = chr(code)
        table[code] = ord(SUBSTITUTES.get(char) or (char.lower() if char.isalnum() else " "))
    return bytes(table) + bytes(range(128, 256))


def fold(text: str, table: bytes | None = None) -> str:
    """Folded text with a space at both ends."""
    table = table or _byte_table()
    raw = text.encode("utf-8", "replace").translate(table)
    plain = raw.decode("utf-8", "replace")
    if not raw.isascii():
        plain = plain.lower()
        # First bytes of the Greek, Cyrillic and full-width blocks.
        if any(lead in raw for lead in (b"\xce", b"\xcf", b"\xd0", b"\xd1", b"\xef")):
            wide = {code: chr(code - 0xFEE0).lower() for code in range(0xFF21, 0xFF5B) if chr(code - 0xFEE0).isalpha()}
            plain = plain.translate({ord(a): b for a, b in HOMOGLYPHS.items()} | wide)
    return f" {plain} "


def automaton(entries: Iterable[str], exceptions: Iterable[str]):
    import ahocorasick

    tree = ahocorasick.Automaton()
    for k, entry in enumerate(entries):
        tree.add_word(f" {entry}", (0, k, len(entry) + 1))
    for phrase in exceptions:
        tree.add_word(f" {phrase} ", (1, phrase, len(phrase) + 2))
    if len(tree):
        tree.make_automaton()
    return tree


def found_in(text: str, tree) -> list[int]:
    """Entries at their word starts, the longest at each; none inside an exception phrase."""
    if not len(tree):
        return []
    best: dict[int, tuple[int, int]] = {}
    spared = []
    for end, (kind, which, length) in tree.iter(text):
        start = end - length + 1
        if kind:
            spared.append((start, end))
        elif start not in best or best[start][0] < length:
            best[start] = (length, which)
    return [which for start, (_, which) in best.items() if not any(a <= start < b for a, b in spared)]


def strength(hits: list[int], weights: list[float], text: str) -> float:
    """Sum of the weights over the logarithm of the number of words."""
    return sum(weights[k] for k in hits) / math.log(math.e + text.count(" ")) if hits else 0.0


def stems(text: str) -> set[str]:
    """Beginnings of the words of a folded text, and the words."""
    found = set()
    for word in set(text.split()):
        for n in range(SHORTEST + 1, min(len(word), LONGEST) + 1):
            found.add(word[:n])
        if SHORTEST <= len(word) <= 2 * LONGEST:
            found.add(word)
    return found


def _count(rows: DataFrame, what) -> DataFrame:
    """(entry, toxic, clean): numbers of sample texts that hold an entry of ``what(text)``."""

    def run(batches: Iterator[pa.RecordBatch]):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                (toxic if label else clean).update(what(fold(text)))
        names = list(toxic.keys() | clean.keys())
        for low in range(0, len(names), 50_000):
            part = names[low:low + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())],
                names=["entry", "toxic", "clean"],
            )

    parts = rows.mapInArrow(run, "entry string, toxic long, clean long")
    return parts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def precision_bound(toxic: Column, clean: Column, z: float = 1.96) -> Column:
    """Wilson's lower bound of the share of toxic texts among those that hold an entry."""
    n, share = toxic + clean, toxic / (toxic + clean)
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - spread) / (1 + z * z / n)


def longest_stems(rows: list) -> dict[str, float]:
    """Weights by entry, without the shorter beginnings which the same texts hold."""
    longer = {(r.entry[:n], r.toxic, r.clean) for r in rows for n in range(SHORTEST, len(r.entry))}
    return {r.entry: r.weight for r in rows if (r.entry, r.toxic, r.clean) not in longer}


def one_of_copies(sample: DataFrame) -> DataFrame:
    """One row (text, toxic) of each label and least hash of five words in a row, so that a group of
    near copies, whose every word looks like a sign of its label, counts about once."""
    words = F.split(F.trim(F.lower("text")), r"\s+")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 5)))
    return sample.withColumn("w", words).groupBy("toxic", F.array_min(runs).alias("run")).agg(F.min("text").alias("text")).select("text", "toxic")


def _cover(holders: list[tuple[int, list[int]]], weights: list[float], names: list[str], least: int, most: int) -> list[int]:
    """Entries which explain most toxic texts not explained yet, strongest first."""
    by_entry: dict[int, set[int]] = {}
    for doc, entries in holders:
        for k in entries:
            by_entry.setdefault(k, set()).add(doc)
    chosen = []
    while len(chosen) < most and by_entry:
        k = max(by_entry, key=lambda x: (len(by_entry[x]) * weights[x], len(names[x]), names[x]))
        docs = by_entry.pop(k)
        if len(docs) < least:
            break
        chosen.append(k)
        for x in list(by_entry):
            by_entry[x] -= docs
            if not by_entry[x]:
                del by_entry[x]
    return chosen


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps."""
    a, b = 0.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y) * x).sum() + ridge * a, (p - y).sum() + ridge * b])
        hess = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def certain_entries(rows: DataFrame, least_texts: int, candidates: int, precision: float, odds) -> dict[str, float]:
    """Entries whose lower bound of precision reaches ``precision`` times the best entry's."""
    kept = _count(rows, stems).withColumn("weight", odds()).where((F.col("toxic") >= least_texts) & (F.col("weight") > 1.0))
    bounded = kept.withColumn("bound", precision_bound(F.col("toxic"), F.col("clean")))
    best = bounded.orderBy(F.desc("bound"), F.desc("toxic"), "entry").limit(candidates).collect()
    return longest_stems([r for r in best if r.bound >= precision * best[0].bound])


def telling_entries(rows: DataFrame, least_texts: int, most: int, candidates: int, least_weight: float, odds) -> dict[str, float]:
    """Entries which together explain the toxic ones of ``rows``, strongest first."""
    kept = _count(rows, stems).withColumn("weight", odds()).where((F.col("toxic") >= least_texts) & (F.col("weight") > least_weight))
    best = kept.orderBy(F.desc(F.col("weight") * F.col("toxic")), "entry").limit(candidates).collect()
    names, weights = [r.entry for r in best], [r.weight for r in best]
    place = {name: k for k, name in enumerate(names)}

    def holders(batches):
        for batch in batches:
            texts = [t for t, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()) if label]
            found = [sorted(place[s] for s in stems(fold(t)) & place.keys()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["entries"])

    texts = [(k, list(r[0])) for k, r in enumerate(rows.mapInArrow(holders, "entries array<int>").collect())]
    return {names[k]: weights[k] for k in _cover(texts, weights, names, max(2, least_texts // 2), most)}


def without(rows: DataFrame, entries: list[str]) -> DataFrame:
    """The rows in which no entry is found."""

    def run(batches: Iterator[pa.RecordBatch]):
        tree = keep_tree(entries, ())
        for batch in batches:
            yield batch.filter(pa.array([not found_in(fold(t), tree) for t in batch.column("text").to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def learn(
    sample: DataFrame, least_texts: int = 4, most_entries: int = 600, candidates: int = 5_000,
    precision: float = 0.9, least_weight: float = 4.0,
) -> Lexicon:
    """A lexicon from rows (text, toxic). Copies of a text count once; without toxic rows it is empty.

    First come the entries that are nearly always a sign of a toxic text, then those that explain
    the toxic texts without such a sign. Every entry stands in ``least_texts`` toxic texts.
    """
    rows = materialize(one_of_copies(sample.selectExpr("coalesce(text, '') text", "toxic = 1 toxic")), "toxic-sample")
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic:
        return Lexicon({})

    def odds() -> Column:
        return F.log(((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1)))

    certain = dict(list(certain_entries(rows, least_texts, candidates, precision, odds).items())[:most_entries])
    rest = materialize(without(rows, list(certain)), "toxic-rest")
    telling = telling_entries(rest, least_texts, most_entries - len(certain), candidates, least_weight, odds)
    lexicon = dict(sorted((telling | certain).items()))
    entries = list(lexicon)

    def phrases(text: str) -> set[str]:
        tree, words, out = keep_tree(entries, ()), text.split(), set()
        for k, word in enumerate(words):
            if found_in(f" {word} ", tree):
                out.update(" ".join(words[a:b]) for a, b in ((k - 1, k + 1), (k, k + 2)) if a >= 0 and b <= len(words))
        return out

    spared = _count(rows, phrases).where((F.col("clean") >= least_texts) & (F.col("clean") >= 9 * F.col("toxic")))
    exceptions = tuple(r.entry for r in spared.orderBy("entry").limit(candidates).collect())

    def features(batches):
        tree, values = keep_tree(entries, exceptions), list(lexicon.values())
        for batch in batches:
            folded = [fold(t) for t in batch.column("text").to_pylist()]
            x = [strength(found_in(t, tree), values, t) for t in folded]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("toxic")], names=["x", "y"])

    points = rows.mapInArrow(features, "x double, y boolean").collect()
    slope, offset = _curve(np.array([p.x for p in points]), np.array([float(p.y) for p in points]))
    return Lexicon(lexicon, exceptions, slope, offset)


def keep_tree(entries: list[str], exceptions: tuple[str, ...]):
    return keep(f"tree:{hash((tuple(entries), exceptions))}", lambda: automaton(entries, exceptions))


def score(documents: DataFrame, lexicon: Lexicon, id_column: str = "doc_id") -> DataFrame:
    """(id, score, n_hits) of every row; null and empty texts have no hits and get the curve's offset.

    Ids may be null or repeat; labels, languages and other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        entries, values, table = list(lexicon.weights), list(lexicon.weights.values()), _byte_table()
        tree = keep_tree(entries, lexicon.exceptions)
        for batch in batches:
            scores, counts = [], []
            for text in batch.column("text"):
                folded = fold(text.as_py() or "", table)
                hits = found_in(folded, tree)
                z = lexicon.slope * strength(hits, values, folded) + lexicon.offset
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                counts.append(len(hits))
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())], names=[id_column, "score", "n_hits"])

    source = documents.selectExpr(f"cast(`{id_column}` as long) `{id_column}`", "cast(text as string) text")
    return source.mapInArrow(run, f"`{id_column}` long, score double, n_hits long")


def training_rows(documents: DataFrame, labels: DataFrame, most: int = 4_000, id_column: str = "doc_id") -> DataFrame:
    """Labelled texts to learn from: at most ``most`` toxic and twice as many clean ones.

    Chosen by the smallest hash of the id, never from ids whose crc32 leaves the remainder 1.
    """
    usable = labels.where(F.col(id_column).isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col(id_column).cast("string")) % 3 != 1))
    picks = [
        usable.where(F.col("toxic") == label).select(id_column, "toxic").orderBy(F.xxhash64(id_column), id_column).limit(n)
        for label, n in ((1, most), (0, 2 * most))
    ]
    chosen = picks[0].unionByName(picks[1]).dropDuplicates([id_column])
    return documents.select(id_column, "text").join(F.broadcast(chosen), id_column).select("text", "toxic")  # 3 * most rows at most
