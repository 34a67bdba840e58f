"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback reads every word; characters per token, the share of
byte tokens and the entropy of the tokens say whether it is prose in a script the vocabulary
knows. Each script has its own rejection band, and so have languages that the rows name; bands are
parameters. The entropy is that of collisions, estimated from pairs of different tokens, so
that it does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from changeloom.llm.token_store import WordCodec
from changeloom.llm.worker import gram_hashes, keep, mix, row_starts, slices, span_hashes, word_spans

# Characters counted as symbols, and the limits of the base rule.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
# First UTF-8 bytes of the letters of a script.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCB)),
    "greek": ((0xCE, 0xCF),),
    "cyrillic": ((0xD0, 0xD4),),
    "semitic": ((0xD6, 0xDD),),
    "indic": ((0xE0, 0xE1),),
    "east_asian": ((0xE3, 0xED),),
    "other": ((0xE2, 0xE2), (0xEE, 0xF4)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Band:
    """Bounds within which a text of a script is kept."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_bits: float


# Bits are set below what clean labelled texts show: 5.27 and more in Latin script, 5.4 to 5.6 and
# more in the languages named; other scripts use far fewer pieces of the vocabulary.
BANDS = {
    "latin": Band(1.35, 9.0, 0.25, 5.2),
    "greek": Band(0.8, 6.0, 0.5, 3.5),
    "cyrillic": Band(0.8, 7.0, 0.5, 4.0),
    "semitic": Band(0.5, 6.0, 0.9, 3.0),
    "indic": Band(0.3, 6.0, 1.0, 2.0),
    "east_asian": Band(0.3, 4.0, 1.0, 3.0),
    "other": Band(0.2, 9.0, 1.0, 0.0),
}
LATIN_LANGUAGES = {"en": 5.5, "de": 5.5, "fr": 5.35}
LANGUAGE_BANDS = {language: Band(1.35, 9.0, 0.25, bits) for language, bits in LATIN_LANGUAGES.items()}


def codec_of(path: str) -> tuple[WordCodec, np.ndarray]:
    """The worker's codec of a sentencepiece model, and which of its ids are bytes."""

    def build():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        is_byte = np.array([model.is_byte(i) for i in range(size)])
        return WordCodec(lambda texts: model.encode(texts, num_threads=1), size), is_byte

    return keep(f"pieces:{path}", build)


def script_table() -> np.ndarray:
    table = np.full(256, len(SCRIPTS), np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for low, high in ranges:
            table[low:high + 1] = k
    return table


def covered(hit: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of ``size`` that begins at a position in ``hit``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, hit, 1)
    np.add.at(step, np.minimum(hit + size, n), -1)
    return np.cumsum(step)[:n] > 0


def twice(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal."""
    codes, distinct = pd.factorize(keys)
    return np.bincount(codes, minlength=len(distinct))[codes] > 1 if len(keys) else np.empty(0, bool)


def base_counts(data: np.ndarray, offsets: np.ndarray, codec: WordCodec) -> dict[str, np.ndarray]:
    """Counts of every row of a slice; copies of lines and windows by their 64-bit hashes."""
    n = len(offsets) - 1
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    starts, ends, rows = word_spans(data, offsets, codec.word)
    hashes = span_hashes(data, starts, ends)
    bounds = row_starts(rows, n)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    line = np.ones(256, bool)
    line[0x0A] = False
    low, high, owner = word_spans(data, offsets, line)
    worded = np.searchsorted(starts, high) > np.searchsorted(starts, low)
    low, high, owner = low[worded], high[worded], owner[worded]
    lines = span_hashes(data, low, high) ^ mix(owner.astype(np.uint64))
    earlier = pd.Series(lines).duplicated().to_numpy() if len(lines) else np.empty(0, bool)
    grams = gram_hashes(hashes, REPEAT_WINDOW)
    inside = rows[:len(grams)] == rows[REPEAT_WINDOW - 1:] if len(grams) else np.empty(0, bool)
    begin = np.flatnonzero(inside)
    begin = begin[twice(grams[begin] ^ mix(rows[begin].astype(np.uint64)))]
    repeated = covered(begin, REPEAT_WINDOW, len(rows))
    lead = codec.word[data] & ((data & 0xC0) != 0x80)
    return {
        "n_words": np.diff(bounds), "word_chars": total(lead), "n_symbols": total(symbol[data]),
        "n_dup_lines": np.bincount(owner, earlier, n).astype(np.int64) if len(owner) else np.zeros(n, np.int64),
        "n_repeat_words": np.diff(np.concatenate(([0], np.cumsum(repeated)))[bounds]),
    }


def token_measures(data: np.ndarray, offsets: np.ndarray, codec: WordCodec, is_byte: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens, byte tokens and entropy per row: bits of the chance that two of its tokens are equal."""
    ids, bounds = codec.encode(data, offsets)
    n = len(bounds) - 1
    tokens = np.diff(bounds)
    owner = np.repeat(np.arange(n), tokens)
    fallback = np.bincount(owner, is_byte[ids], n) if len(ids) else np.zeros(n)
    codes, distinct = pd.factorize(owner * np.int64(1 << 32) + ids)
    counts = np.bincount(codes, minlength=len(distinct)).astype(float)
    pairs = np.bincount(distinct >> 32, counts * (counts - 1), n) if len(ids) else np.zeros(n)
    every = tokens * (tokens - 1.0)
    return tokens, fallback, np.log2(np.maximum(every, 1) / np.maximum(pairs, 1))


def bands_of(script: np.ndarray, languages: list[str | None] | None, bands: dict[str, Band]) -> np.ndarray:
    """Limits per row: those of its language if there are any and its script is Latin, else of its script."""
    names = list(SCRIPTS)
    chosen = [names[k] for k in script]
    if languages is not None:
        chosen = [x if x in bands and s == "latin" else s for s, x in zip(chosen, languages)]
    return np.array([[b.least_chars, b.most_chars, b.most_bytes, b.least_bits] for b in map(bands.get, chosen)]).reshape(-1, 4)


def measure(data: np.ndarray, offsets: np.ndarray, model: str, bands: dict[str, Band], languages: list[str | None] | None = None) -> dict[str, np.ndarray]:
    codec, is_byte = codec_of(model)
    n = len(offsets) - 1
    out = base_counts(data, offsets, codec)
    tokens, fallback, bits = token_measures(data, offsets, codec, is_byte)
    table = script_table()[data]
    letters = np.stack([np.diff(np.concatenate(([0], np.cumsum(table == k)))[offsets]) for k in range(len(SCRIPTS))])
    script = np.where(letters.max(0) > 0, letters.argmax(0), len(SCRIPTS) - 1) if n else np.empty(0, int)
    limits = bands_of(script, languages, bands)
    chars = out["word_chars"] / np.maximum(tokens, 1)
    byte_share = fallback / np.maximum(tokens, 1)
    words = out["n_words"]
    failed = (words < LEAST_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * words)
    good = (chars >= limits[:, 0]) & (chars <= limits[:, 1]) & (byte_share <= limits[:, 2]) & (bits >= limits[:, 3])
    return out | {
        "n_tokens": tokens, "base_failed": failed, "kept": ~failed & good, "chars_per_token": chars,
        "byte_share": byte_share, "bits": bits, "script": np.array(list(SCRIPTS))[script],
    }


FIELDS = {**{c: pa.int64() for c in COUNTS}, "base_failed": pa.bool_(), "kept": pa.bool_(), "n_tokens": pa.int64(),
          "chars_per_token": pa.float64(), "byte_share": pa.float64(), "bits": pa.float64(), "script": pa.string()}
TYPES = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double", pa.string(): "string"}


def languages_of(batch: pa.RecordBatch, column: str | None) -> list[str | None] | None:
    return batch.column(column).cast(pa.string()).to_pylist() if column else None


def score(
    documents: DataFrame, model: str, id_column: str = "doc_id", bands: dict[str, Band] | None = None,
    language_column: str | None = None,
) -> DataFrame:
    """Measures and verdict of every text, one row per input row.

    A null text counts as empty and fails the base rule, as every text under 20 words does. A text
    without letters has the script ``other``; without a known language the script's band holds. Ids
    may be null or repeat; other columns are left out.
    """
    chosen = BANDS | LANGUAGE_BANDS | (bands or {})

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            languages = languages_of(batch, "language" if language_column else None)
            for low, high, data, offsets in slices(batch.column("text")):
                found = measure(data, offsets, model, chosen, languages and languages[low:high])
                columns = [pa.array(found[c], kind) for c, kind in FIELDS.items()]
                yield pa.RecordBatch.from_arrays([batch.column("id")[low:high], *columns], names=[id_column, *FIELDS])

    schema = f"`{id_column}` long, " + ", ".join(f"{c} {TYPES[kind]}" for c, kind in FIELDS.items())
    columns = [f"cast(`{id_column}` as long) id", "cast(text as string) text"]
    if language_column:
        columns.append(f"cast(`{language_column}` as string) language")
    return documents.selectExpr(*columns).mapInArrow(run, schema)


def keep_good(
    documents: DataFrame, model: str, bands: dict[str, Band] | None = None, language_column: str | None = None
) -> DataFrame:
    """The rows whose text is kept, with all their columns; no shuffle and no join."""
    chosen = BANDS | LANGUAGE_BANDS | (bands or {})

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            languages = languages_of(batch, language_column)
            for low, high, data, offsets in slices(batch.column("text")):
                verdict = measure(data, offsets, model, chosen, languages and languages[low:high])["kept"]
                yield batch.slice(low, high - low).filter(pa.array(verdict))

    return documents.mapInArrow(run, T.StructType(documents.schema.fields))
