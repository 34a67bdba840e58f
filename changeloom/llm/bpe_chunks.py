"""BPE encoding and decoding that reuses content-defined chunks.

A rolling hash over the bytes cuts every text where the content says so; equal passages are cut
alike wherever they stand. A chunk's *body* runs from its first to its last safe place: a white
space behind something else, where the token pattern starts anew whatever stands around it. A
body is encoded once per worker and reused for every document that holds the chunk. What lies
between two bodies is the *join*: it is encoded again over both chunks, and grows over chunks
without a safe place until both ends agree with the whole text's tokens, at worst to the text.

Nothing is shuffled: a table of all chunks would move the whole corpus twice, more than the
encoding costs. So a worker knows the chunks it has met, within a bound on their bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeloom.llm.worker import keep, slices, stream

SPECIAL = "<|endoftext|>"
RESULT = "{id} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
MIN_CHUNK, CHUNK_BITS, MEMO_BYTES = 256, 10, 48 << 20
HASH_WINDOW = 16


def cuts(data: np.ndarray) -> np.ndarray:
    """Byte positions where a rolling hash of the 16 bytes before them has ten zero bits."""
    if len(data) <= HASH_WINDOW:
        return np.empty(0, np.int64)
    values = stream(31, 256).astype(np.uint32)[data]
    rolled, span = values, 1
    while span < HASH_WINDOW:  # doubling: windows of 2, 4, 8, 16 bytes
        rolled = rolled[:-span] * np.uint32(0x01000193 ** span & 0xFFFFFFFF | 1) + rolled[span:]
        span *= 2
    return np.flatnonzero(rolled >> np.uint32(32 - CHUNK_BITS) == 0) + HASH_WINDOW


class Codec:
    """A byte-level vocabulary with a memory of encoded chunk bodies."""

    def __init__(self, ranks: str, pattern: str, same: str, special: str = SPECIAL):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = special
        self.tokens = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={special: len(table)}
        )
        self.same, self.other = same, lambda: Tokenizer.from_file(same)
        self.memo: dict[bytes, np.ndarray] = {}
        self.held = 0

    def plain(self, part: bytes) -> np.ndarray:
        text = part.decode("utf-8", "replace")
        try:
            return np.array(self.tokens.encode(text, allowed_special={self.special}), "<u4")
        except ValueError:  # its pattern engine gives up on a million white spaces in a row
            whole = keep(f"tokenizer:{self.same}", self.other)
            whole.no_truncation()
            whole.no_padding()
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")

    def body(self, part: bytes) -> np.ndarray:
        ids = self.memo.get(part)
        if ids is None:
            ids = self.plain(part)
            if self.held > MEMO_BYTES:
                self.memo.clear()
                self.held = 0
            self.memo[part] = ids
            self.held += len(part) + ids.nbytes + 200
        return ids

    def encode(self, data: np.ndarray, marks: np.ndarray, safe: np.ndarray) -> np.ndarray:
        """Ids of one text; ``marks`` are its cuts, ``safe`` its safe places, both ascending."""
        raw = data.tobytes()
        if len(marks) == 0:
            return self.plain(raw)
        edges = np.concatenate(([0], marks, [len(raw)]))
        first = np.searchsorted(safe, edges[:-1])
        last = np.searchsorted(safe, edges[1:])
        parts, done = [], 0
        for low, high in zip(first, last):
            if high - low < 2:  # no body; the join goes on over this chunk
                continue
            begin, end = int(safe[low]), int(safe[high - 1])
            if begin > done:
                parts.append(self.plain(raw[done:begin]))
            parts.append(self.body(raw[begin:end]))
            done = end
        if done < len(raw):
            parts.append(self.plain(raw[done:]))
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.tokens.decode_bytes(ids.tolist()).decode("utf-8", "replace")


def safe_places(data: np.ndarray) -> np.ndarray:
    """Positions of a white space behind another character; both in ASCII."""
    if len(data) < 2:
        return np.empty(0, np.int64)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    # Letters and digits only: no pattern reaches from them over a white space.
    lower = data | np.uint8(0x20)
    solid = ((lower >= 0x61) & (lower <= 0x7A)) | ((data >= 0x21) & (data <= 0x2F)) | ((data >= 0x30) & (data <= 0x3F))
    return np.flatnonzero(space[1:] & solid[:-1]) + 1


def spaced(marks: np.ndarray, least: int = MIN_CHUNK) -> np.ndarray:
    """Drop cuts that follow the one kept before them within ``least`` bytes."""
    kept, before = [], 0
    for mark in marks.tolist():
        if mark - before >= least:
            kept.append(mark)
            before = mark
    return np.array(kept, np.int64)


def encode_batches(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str, same: str, id_column: str, ids_too: bool):
    codec = keep(f"codec:{ranks}", lambda: Codec(ranks, pattern, same))
    for batch in batches:
        ids_of, counts, encoded, decoded = batch.column(id_column), [], [], []
        lists = []
        for _, _, data, offsets in slices(batch.column("text")):
            marks, safe = cuts(data), safe_places(data)
            for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                a, b = np.searchsorted(marks, [low + HASH_WINDOW, high])
                c, d = np.searchsorted(safe, [low + 1, high])
                ids = codec.encode(data[low:high], spaced(marks[a:b] - low), safe[c:d] - low)
                counts.append(len(ids))
                encoded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                if ids_too:
                    lists.append(ids.astype(np.int32))
        columns = [ids_of, pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
        names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
        if ids_too:
            columns.append(pa.array(lists, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encode_documents(documents: DataFrame, ranks: str, pattern: str, same: str, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per input row: token count and digests of the ids and of the decoded text.

    ``ranks`` is a rank file at the same place on every machine, ``pattern`` its split pattern,
    ``same`` the same vocabulary as a tokenizer file.
    Null and empty texts have no tokens; a null id stays null; repeated rows give repeated
    results; other columns are left out; an empty table gives none. ``with_ids`` adds the ids.
    """
    schema = RESULT.format(id=id_column) + (", ids array<int>" if with_ids else "")

    def run(batches):
        return encode_batches(batches, ranks, pattern, same, id_column, with_ids)

    source = documents.selectExpr(f"cast(`{id_column}` as long) `{id_column}`", "cast(text as string) text")
    return source.mapInArrow(run, schema)
