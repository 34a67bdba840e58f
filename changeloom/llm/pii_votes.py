"""Personal data by weak supervision.

Patterns find candidate spans: the base kinds, and wider forms (disguised addresses, numbers in
national form, numbers that fail a check, names after a title or from a list, accounts, dates of
birth). Labelers (strict format, check digits, gazetteers, words around, boundaries, fillers) vote
for, against or not at all. Votes are counted over all documents; expectation-maximisation on the
table of vote patterns estimates how reliable every labeler is for every kind, and how likely each
pattern is personal data. A logistic classifier of spans is then trained on those likelihoods, so
that shape and neighbourhood count as well, and decides about all candidates that are not base.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.worker import slices
from changeloom.sources.shared import materialize

# Kinds in the order of results, and the base patterns with their conditions below.
KINDS = ("email", "ip", "card", "phone", "iban", "number", "name", "birth")
LOCAL, DOMAIN = "A-Za-z0-9._%+-", r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Common top-level domains, calling codes, IBAN lengths, titles, first names.
DOMAINS = "com org net edu gov mil int info biz io dev app ai co uk us ca au nz ie de at ch fr be lu nl es pt it gr pl cz se no dk fi ru ua tr in cn jp kr br mx ar cl pe za eu me tv".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 358 372 380 420 421 852 886 966 971 972".split()
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Don", "Doña")
FIRST_NAMES = (
    "Adam Alice Alejandro Ana Andreas Anna Anne Antonio Barbara Ben Bernard Camille Carlos Carmen Carol Charles Charlotte "
    "Claire Claudia Cristina Daniel David Diego Dieter Elena Elisabeth Emily Emma Eva Felix Fernando Francisco Frank Hannah "
    "Hans Heinz Helen Helga Isabel Jack Jacques James Jan Javier Jean Jennifer Jens Jessica Joachim John Jorge Josef Jose Juan "
    "Julia Karen Karin Karl Klaus Laura Lena Lisa Louis Lucas Lucia Luis Luise Manuel Maria Marie Mark Martin Mary Michael "
    "Miguel Monika Nathalie Nicolas Olivia Patricia Paul Paula Pedro Peter Philippe Pierre Rachel Rafael Robert Rosa Ruth "
    "Sandra Sarah Sofia Sophie Stefan Susan Thomas Ursula Victor Werner William Wolfgang"
).split()
# Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "email mail e-mail contact write kontakt courriel correo address adresse",
    "ip": "ip host server address login client adresse direccion serveur from",
    "card": "card visa mastercard amex credit karte carte tarjeta payment kreditkarte",
    "phone": "phone tel telephone call mobile cell fax telefon anruf téléphone appelez teléfono llame móvil",
    "iban": "iban account bank konto compte cuenta transfer überweisung",
    "number": "ssn social security passport ausweis personalausweis passeport dni pasaporte national",
    "name": "name named patient customer dear signed contact herr frau monsieur señor",
    "birth": "born birth birthday dob birthdate geboren geburtsdatum geburtstag née né naissance nacido nacida nacimiento",
}
AGAINST = frozenset("version release build isbn issn order ticket invoice error line page chapter section row column figure table serial sku hash commit token port ratio score rfc doi".split())

TITLE = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.?\x20(?P<name>[^\W\d_]\w+(?:\x20[^\W\d_]\w+)?)")
FULL_NAME = re.compile(rf"(?<!\w)(?:{'|'.join(FIRST_NAMES)})\x20[^\W\d_]\w+(?!\w)")
AT = re.compile(r"\x20?(?:\(at\)|\[at\])\x20?|\x20at\x20", re.I)
SPOKEN = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+", re.I)
BEFORE_AT = re.compile(rf"[{LOCAL}]{{1,64}}\Z")
NATIONAL = re.compile(r"(?<![\w+.(-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){1,4}(?![\w-]|\.[0-9])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?!\w)")
SOCIAL = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
DATE = re.compile(r"(?<![\w./-])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![\w/-]|\.[0-9])")
WORD = re.compile(r"[^\W\d_][\w-]*")
LABELERS = ("format", "check", "gazetteer", "cue", "against", "boundary", "filler")
AROUND = 48
BITS = 12
RESULT = "spans array<struct<kind:string,start:int,end:int,base:boolean,chance:double>>"


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern, found from each sign: one before it decides the start."""
    domain, last, at = re.compile(DOMAIN), 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        found = domain.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def strict(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether its condition holds) of all matches of the base patterns."""
    found = [("email", a, b, True) for a, b in emails(text)]
    found += [("ip", *m.span(), all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))) for m in re.finditer(IP, text)]
    for m in re.finditer(CARD, text):
        digits = only_digits(m[0])
        found.append(("card", *m.span(), 16 <= len(digits) <= 19 and luhn(digits)))
    found += [("phone", *m.span(), 8 <= len(only_digits(m[0])) <= 15) for m in re.finditer(PHONE, text)]
    return found


def candidates(text: str) -> list[Span]:
    """All candidate spans, base ones first; one place may be a candidate of several kinds."""
    matches = strict(text)
    out = [Span(kind, a, b, True) for kind, a, b, good in matches if good]
    out += [Span(kind, a, b, False) for kind, a, b, good in matches if not good and (kind != "card" or 12 <= len(only_digits(text[a:b])) <= 19)]
    if re.search(r"[0-9]", text):
        out += [Span("phone", *m.span(), False) for m in NATIONAL.finditer(text) if 7 <= len(only_digits(m[0])) <= 15]
        out += [Span("iban", *m.span(), False) for m in IBAN.finditer(text)]
        out += [Span("number", *m.span(), False) for m in SOCIAL.finditer(text)]
        out += [Span("birth", *m.span(), False) for m in DATE.finditer(text)]
    lowered = text.lower()
    if "(at)" in lowered or "[at]" in lowered or " dot " in lowered:
        for m in AT.finditer(text):
            left, right = BEFORE_AT.search(text[max(0, m.start() - 64):m.start()]), SPOKEN.match(text, m.end())
            if left and right and (m[0].strip().lower() != "at" or re.search("dot", right[0], re.I)):
                out.append(Span("email", m.start() - len(left[0]), right.end(), False))
    out += [Span("name", *m.span("name"), False) for m in TITLE.finditer(text) if m["name"][0].isupper()]
    out += [Span("name", *m.span(), False) for m in FULL_NAME.finditer(text) if m[0].split(" ")[1][0].isupper()]
    known = {}
    for span in out:
        known.setdefault((span.kind, span.start, span.end), span)
    return list(known.values())


def votes(text: str, span: Span) -> tuple[tuple[int, ...], list[str]]:
    """The labelers' votes (1 for, -1 against, 0 none) and the words before the span."""
    piece = text[span.start:span.end]
    digits = only_digits(piece)
    before = [w.lower() for w in WORD.findall(text[max(0, span.start - AROUND):span.start])]
    lead = text[span.start - 1] if span.start else " "
    tail = text[span.end] if span.end < len(text) else " "
    format_ = check = gazetteer = 0
    if span.kind == "email":
        format_ = 1 if "@" in piece and ".." not in piece and not piece.startswith(".") else -1 if ".." in piece else 0
        last = re.split(r"[^A-Za-z0-9-]+", piece.strip())[-1].lower()
        gazetteer = 1 if last in DOMAINS else -1
    elif span.kind == "ip":
        parts = piece.split(".")
        format_ = 1 if all(int(p[-4:]) <= 255 and len(p) <= 3 and (p == "0" or p[0] != "0") for p in parts) else -1
        check = -1 if parts[0].strip("0") == "" or all(len(p) == 1 for p in parts) else 1
    elif span.kind == "card":
        format_ = 1 if 13 <= len(digits) <= 19 else -1
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif span.kind == "phone":
        format_ = 1 if piece[0] == "+" else -1 if len(digits) < 9 else 0
        check = 1 if 8 <= len(digits) <= 15 else -1
        national = digits[2:] if digits.startswith("00") else digits
        gazetteer = (1 if any(national.startswith(c) for c in CALLING) else -1) if piece[0] == "+" or digits.startswith("00") else 0
    elif span.kind == "iban":
        plain = piece.replace(" ", "")
        format_ = 1 if IBAN_LENGTHS.get(plain[:2]) == len(plain) else -1
        check = 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
        gazetteer = 1 if plain[:2] in IBAN_LENGTHS else -1
    elif span.kind == "number":
        format_ = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif span.kind == "name":
        words = piece.split(" ")
        gazetteer = 1 if words[0] in FIRST_NAMES else 0
        format_ = 1 if all(w[:1].isupper() and w[1:].islower() for w in words) else -1
        check = 1 if re.search(rf"(?:{'|'.join(TITLES)})\.?\x20\Z", text[max(0, span.start - 12):span.start]) else 0
    else:
        year = int(re.search("[0-9]{4}", piece)[0])
        parts = [int(x) for x in re.findall("[0-9]+", piece) if len(x) < 4]
        format_ = 1 if min(parts) >= 1 and min(parts) <= 12 and max(parts) <= 31 else -1
        check = 1 if 1900 <= year <= 2020 else -1
    cues = set(CUES[span.kind].split())
    cue = 1 if any(w in cues for w in before[-6:]) else 0
    against = -1 if any(w in AGAINST for w in before[-4:]) else 0
    boundary = -1 if lead.isalnum() or tail.isalnum() or lead in "_=/\\&#-" or tail in "_=/\\-" else 1
    filler = -1 if digits and (len(set(digits)) == 1 or digits in "01234567890123456789" or digits in "98765432109876543210") else 0
    return (format_, check, gazetteer, cue, against, boundary, filler), before


def features(text: str, span: Span, vote: tuple[int, ...], before: list[str]) -> list[int]:
    """Places of the span's features among 2^12."""
    piece = text[span.start:span.end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[^\\W\\d_]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", piece))))
    around = lambda c: "a" if c.isalpha() else "9" if c.isdigit() else " " if c.isspace() else c
    found = [f"{name}{v}" for name, v in zip(LABELERS, vote)]
    found += ["", f"shape {shape[:1]}{shape[-1:]}{len(shape).bit_length()}", f"signs {''.join(sorted(set(shape)))}", f"size {len(piece).bit_length()}"]
    found += [f"lead {around(text[span.start - 1]) if span.start else '^'}", f"tail {around(text[span.end]) if span.end < len(text) else '$'}", f"word {before[-1] if before else ''}"]
    return [zlib.crc32(f"{span.kind}:{x}".encode()) & ((1 << BITS) - 1) for x in found]


N_FEATURES = len(LABELERS) + 7


def worth(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows that can hold a candidate: a digit, an address sign or bracket, or a capital after a blank."""
    for first, last, data, offsets in slices(column):
        total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
        mark = np.zeros(256, bool)
        mark[list(b"0123456789@([")] = True
        capital = np.zeros(256, bool)
        capital[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\xc3")] = True
        flag = mark[data]
        flag[1:] |= capital[data[1:]] & (data[:-1] == 0x20)
        yield first, last, total(flag) > 0


def vote_table(documents: DataFrame, id_column: str) -> DataFrame:
    """(kind, votes, features, order) of all candidates of all documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            rows = []
            for first, last, flag in worth(batch.column("text")):
                for k in np.flatnonzero(flag).tolist():
                    text = batch.column("text")[first + k].as_py() or ""
                    for span in candidates(text):
                        vote, before = votes(text, span)
                        code = sum((v + 1) * 3**n for n, v in enumerate(vote))
                        order = zlib.crc32(f"{ids[first + k]}:{span.start}:{span.end}:{text[span.start:span.end]}".encode())
                        rows.append((KINDS.index(span.kind), code, features(text, span, vote, before), order))
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["kind", "code", "features", "place"])

    source = documents.selectExpr(f"cast(`{id_column}` as string) id", "cast(text as string) text")
    return source.mapInArrow(run, "kind int, code int, features array<int>, place long")


def unpack(code: int) -> tuple[int, ...]:
    return tuple(code // 3**n % 3 - 1 for n in range(len(LABELERS)))


def estimate(counts: dict[tuple[int, int], int], rounds: int = 60, shared: float = 20.0) -> dict[tuple[int, int], float]:
    """Chance of every (kind, vote pattern) by expectation-maximisation.

    Two classes; a labeler's votes are independent given the class. Each kind has its own rates,
    drawn towards those of all kinds together by ``shared`` further cases. The first guess is the
    majority of the votes.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    kind = np.array([k for k, _ in patterns])
    vote = np.array([unpack(c) for _, c in patterns]) + 1
    weight = np.array([counts[p] for p in patterns], float)
    balance = (vote - 1).sum(1)
    chance = np.clip(0.5 + 0.2 * balance, 0.05, 0.95)
    n_kinds, n_labelers = len(KINDS), len(LABELERS)
    for _ in range(rounds):
        log = np.zeros((2, len(patterns)))
        for side, part in enumerate((1 - chance, chance)):
            mass = weight * part
            each, every = np.zeros((n_kinds, n_labelers, 3)), np.zeros((n_labelers, 3))
            for n in range(n_labelers):
                np.add.at(each[:, n], (kind, vote[:, n]), mass)
                every[n] = np.bincount(vote[:, n], mass, 3)
            every = (every + 1) / (every + 1).sum(1, keepdims=True)
            rate = each + shared * every
            rate /= rate.sum(2, keepdims=True)
            prior = np.bincount(kind, mass, n_kinds) + 1
            total = np.bincount(kind, weight, n_kinds) + 2
            log[side] = np.log(prior / total)[kind] + sum(np.log(rate[kind, n, vote[:, n]]) for n in range(n_labelers))
        chance = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return dict(zip(patterns, chance.tolist()))


def train(places: np.ndarray, target: np.ndarray, rounds: int = 400, penalty: float = 1e-4) -> np.ndarray:
    """Weights of the logistic classifier, by adaptive gradient steps over all rows at once."""
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-np.clip(weights[places].sum(1), -50, 50)))
        step = np.bincount(places.ravel(), np.repeat(guess - target, places.shape[1]), 1 << BITS) / len(places) + penalty * weights
        seen += step * step
        weights -= 0.3 * step / np.sqrt(seen)
    return weights


@dataclass(frozen=True)
class Model:
    """Weights of the span classifier (none where nothing was learned), and its threshold."""

    weights: np.ndarray | None
    threshold: float
    chances: dict[tuple[int, int], float]


def learn(documents: DataFrame, threshold: float = 0.8, sample: int = 4_000, id_column: str = "doc_id") -> Model:
    """The model of a corpus.

    Votes are counted over the candidates of all documents. The classifier is fitted on at most
    ``sample`` candidates of each kind, those with the smallest hash.
    """
    table = materialize(vote_table(documents, id_column), "votes")
    counts = {(r.kind, r.code): r.n for r in table.groupBy("kind", "code").agg(F.count("*").alias("n")).collect()}
    chances = estimate(counts)
    if not chances:
        return Model(None, threshold, {})
    order = Window.partitionBy("kind").orderBy("place", "code", "features")
    chosen = table.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("kind", "code", "features").collect()
    places = np.array([r.features for r in chosen], np.int64)
    return Model(train(places, np.array([chances[r.kind, r.code] for r in chosen])), threshold, chances)


def decide(text: str, model: Model) -> list[tuple[str, int, int, bool, float]]:
    """Base spans, and the candidates that the classifier takes, likeliest first where they overlap."""
    found, offers = [], []
    spans = candidates(text)
    taken = [(s.start, s.end) for s in spans if s.base]
    for span in spans:
        chance = 1.0
        if model.weights is not None:
            vote, before = votes(text, span)
            chance = float(1 / (1 + math.exp(-max(-50, min(50, model.weights[features(text, span, vote, before)].sum())))))
        if span.base:
            found.append((span.kind, span.start, span.end, True, chance))
        elif model.weights is not None and chance >= model.threshold:
            offers.append((span.kind, span.start, span.end, False, chance))
    held = Held(taken)
    for one in sorted(offers, key=lambda x: (-x[4], x[1] - x[2], x[1], KINDS.index(x[0]))):
        if held.free(one[1], one[2]):
            held.add(one[1], one[2])
            found.append(one)
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


class Held:
    """Taken places of a text, by blocks of 64 letters."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.blocks: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a, b in spans:
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        for k in range(a >> 6, ((b - 1) >> 6) + 1):
            self.blocks[k].append((a, b))

    def free(self, a: int, b: int) -> bool:
        return not any(x < b and a < y for k in range(a >> 6, ((b - 1) >> 6) + 1) for x, y in self.blocks.get(k, ()))


def find(documents: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """(id, spans) of every row, spans in code points by kind, then start.

    Null and empty texts have none. Ids may repeat or be null; rows are judged one by one, and other
    columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("chance", pa.float64())]))
        names = ("kind", "start", "end", "base", "chance")
        for batch in batches:
            out = [[] for _ in range(batch.num_rows)]
            for first, last, flag in worth(batch.column("text")):
                for k in np.flatnonzero(flag).tolist():
                    out[first + k] = [dict(zip(names, s)) for s in decide(batch.column("text")[first + k].as_py() or "", model)]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(out, kind)], names=[id_column, "spans"])

    source = documents.selectExpr(f"cast(`{id_column}` as long) `{id_column}`", "cast(text as string) text")
    return source.mapInArrow(run, f"`{id_column}` long, {RESULT}")


def mask(documents: DataFrame, model: Model) -> DataFrame:
    """Documents with every span replaced by its kind in angle brackets, of overlapping ones the first;
    all columns stay, and texts without spans stay as they are (null too)."""

    def hide(text: str | None) -> str | None:
        out, at = [], 0
        for kind, start, end, _, _ in sorted(decide(text or "", model), key=lambda s: (s[1], -s[2])):
            if start >= at:
                out += [text[at:start], f"<{kind}>"]
                at = end
        return text if not out else "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, batch.schema.field(place), pa.array([hide(t) for t in batch.column("text").to_pylist()], batch.schema.field(place).type))

    return documents.mapInArrow(run, documents.schema)
