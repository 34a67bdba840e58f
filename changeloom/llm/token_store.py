"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A store is a folder with one dictionary and shards. A shard holds a header, one zstandard frame
per document, an index (id, offset, token count) and a footer with the place of the index and
the SHA-256 of the dictionary. A single document costs one index read and one frame. Shards
follow the order of ids. Tasks write files under names of their own; a shard counts once the
manifest lists it, so a retried or lost task leaves at most an unlisted file.

Texts are encoded word by word: no token of the vocabulary reaches over ASCII white space, so a
word's ids are the same in every text. Words are found and looked up as arrays of hashes, and the
tokenizer sees a word once per worker (the memory is bounded and starts anew). Words are found by
64-bit hashes and their bytes compared; a slice with two words of one hash is encoded word by word.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.llm.worker import keep, equal_spans, slices, space_words, span_hashes, word_spans
from changeloom.sources.shared import materialize, new_path

MAGIC = b"CLTOKEN1"
FOOTER = "<qqq32s8s"
MANIFEST = "shard int, file string, docs long, tokens long, bytes long, dictionary string"
MEMO_WORDS, MEMO_BYTES = 1_200_000, 32 << 20
LONG_WORD = 1 << 16


def doubled(values: np.ndarray) -> np.ndarray:
    """The values with as much room behind them, which takes memory once it is used."""
    out = np.empty(2 * len(values), values.dtype)
    out[:len(values)] = values
    return out


class WordCodec:
    """Encodes slices of texts; every distinct word goes through ``encode_words`` once."""

    def __init__(self, encode_words: Callable[[list[str]], list[list[int]]], vocabulary: int):
        self.encode_words = encode_words
        self.word = space_words()
        self.width = 2 if vocabulary <= 1 << 16 else 4
        self.forget()

    def forget(self) -> None:
        # Hashes in order and the words' numbers: two arrays, as a dict takes about 200 bytes a word.
        self.known, self.slots = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.starts, self.lengths = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)
        self.flat = np.empty(1 << 18, np.uint32)
        self.text, self.places = np.empty(1 << 20, np.uint8), np.empty(1 << 16, np.int64)
        self.words = self.used = self.letters = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes, -1 for unknown ones."""
        if len(self.known) == 0:
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.slots[at], -1).astype(np.int64)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, at, hashes[order])
        self.slots = np.insert(self.slots, at, self.words + order)
        for low in range(0, len(words), 4096):
            texts = [w.decode("utf-8", "replace") for w in words[low:low + 4096]]
            found = self.encode_words(texts)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for one in found for i in one), np.uint32, int(sizes.sum()))
            while self.words + len(found) > len(self.starts):
                self.starts, self.lengths, self.places = doubled(self.starts), doubled(self.lengths), doubled(self.places)
            while self.used + len(ids) > len(self.flat):
                self.flat = doubled(self.flat)
            part = words[low:low + 4096]
            letters = np.frombuffer(b"".join(part), np.uint8)
            while self.letters + len(letters) > len(self.text):
                self.text = doubled(self.text)
            new = slice(self.words, self.words + len(found))
            self.starts[new] = self.used + np.cumsum(sizes) - sizes
            self.lengths[new] = sizes
            self.text[self.letters:self.letters + len(letters)] = letters
            self.places[new] = self.letters + np.cumsum([0] + [len(w) for w in part[:-1]])
            self.letters += len(letters)
            self.flat[self.used:self.used + len(ids)] = ids
            self.words, self.used = new.stop, self.used + len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, and where each row's ids begin (and the end)."""
        if self.words > MEMO_WORDS or self.letters > MEMO_BYTES:
            self.forget()
        starts, ends, rows = word_spans(data, offsets, self.word)
        if len(starts) == 0:
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = span_hashes(data, starts, ends)
        codes, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        known = self.find(distinct)
        new = np.flatnonzero(known < 0)
        if len(new):
            raw = data.tobytes()
            at = first[new]
            self.learn(distinct[new], [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            known = self.find(distinct)
        slots = known[codes]
        size = ends - starts
        long = np.flatnonzero(size > 8)  # shorter words of one size never share a hash
        if not (
            np.array_equal(size, size[first][codes])
            and equal_spans(data, starts[long], data, starts[first][codes[long]], size[long])
            and equal_spans(data, starts[first], self.text, self.places[known], size[first])
        ):
            return self.encode_apart(data, offsets, starts, ends, rows)
        sizes = self.lengths[slots]
        after = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[slots] - (after - sizes), sizes) + np.arange(after[-1])]
        bounds = np.concatenate(([0], after))[np.searchsorted(rows, np.arange(len(offsets)))]
        return ids, bounds


    def encode_apart(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by whole words, for slices with words that share a hash."""
        raw = data.tobytes()
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
        distinct = list(dict.fromkeys(words))
        known = dict(zip(distinct, self.encode_words(distinct)))
        found = [known[w] for w in words]
        after = np.cumsum([0] + [len(ids) for ids in found])
        return np.array([i for ids in found for i in ids], np.uint32), after[np.searchsorted(rows, np.arange(len(offsets)))]


def codec_of(path: str) -> WordCodec:
    """The worker's codec of a tokenizer file."""

    def build() -> WordCodec:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return WordCodec(
            lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)],
            tokenizer.get_vocab_size(with_added_tokens=True),
        )

    return keep(f"words:{path}", build)


def train_dictionary(documents: DataFrame, tokenizer: str, id_column: str, sample: int, size: int) -> bytes:
    """A dictionary from the ``sample`` documents with the smallest hash of their id.

    Only the bytes on disk depend on the sample. Too little text gives an empty dictionary.
    """
    import zstandard

    key = F.xxhash64(id_column)
    chosen = [r[0] for r in documents.where(F.col(id_column).isNotNull()).select(id_column).orderBy(key, id_column).limit(sample).collect()]
    rows = documents.where(F.col(id_column).isin(chosen)).select(F.substring("text", 1, LONG_WORD).alias("text")).limit(2 * sample)

    def serialize(batches):
        codec = codec_of(tokenizer)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                ids, bounds = codec.encode(data, offsets)
                raw = [ids[a:b].astype(f"<u{codec.width}").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["ids"])

    samples = [bytes(r[0]) for r in rows.mapInArrow(serialize, "ids binary").collect() if len(r[0]) >= 8]
    if sum(map(len, samples)) < 16 * size or len(samples) < 16:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


def write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, dictionary: bytes, id_column: str):
    import zstandard

    codec = codec_of(tokenizer)
    digest = hashlib.sha256(dictionary).digest()
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=3, dict_data=held)
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    part = TaskContext.get().partitionId()
    name = f"shard-{part:06d}-{uuid.uuid4().hex}.tok"
    out, at, total, index = None, 0, 0, []
    end = np.array([end_id], np.uint32)
    for batch in batches:
        ids_of = batch.column(id_column)
        for low, high, data, offsets in slices(batch.column("text")):
            if out is None:
                out = system.open_output_stream(f"{root}/{name}")
                out.write(MAGIC + bytes([codec.width]))
                at = len(MAGIC) + 1
            ids, bounds = codec.encode(data, offsets)
            bounds = bounds.tolist()
            for row, doc in enumerate(ids_of[low:high].to_pylist()):
                one = np.concatenate((ids[bounds[row]:bounds[row + 1]], end)).astype(f"<u{codec.width}")
                frame = press.compress(one.tobytes())
                out.write(frame)
                index.append((doc is not None, doc or 0, at, len(one)))
                at += len(frame)
                total += len(one)
    if out is None:
        return
    table = press.compress(np.array(index, "<i8").tobytes())
    out.write(table + struct.pack(FOOTER, at, len(table), len(index), digest, MAGIC))
    out.close()
    row = [[part], [f"{folder}/{name}"], [len(index)], [total], [at + len(table) + struct.calcsize(FOOTER)], [digest.hex()]]
    types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["shard", "file", "docs", "tokens", "bytes", "dictionary"])


def write_store(documents: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", sample: int = 1_000, dictionary_bytes: int = 1 << 16) -> tuple[str, DataFrame]:
    """Write all documents in ascending order of their id; returns the folder and the manifest.

    Null and empty texts hold only the end id. A null id stands first and stays null. Rows that
    repeat an id are all kept, next to each other. An empty table gives an empty manifest.
    """
    spark = documents.sparkSession
    source = documents.selectExpr(f"cast(`{id_column}` as long) `{id_column}`", "cast(text as string) text")
    folder = new_path(spark, "token-store")
    folder = folder if "://" in folder else f"file://{folder}"
    dictionary = train_dictionary(source, tokenizer, id_column, sample, dictionary_bytes)
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{hashlib.sha256(dictionary).hexdigest()}.dictionary") as out:
        out.write(dictionary)

    def run(batches):
        return write_shard(batches, folder, tokenizer, end_id, dictionary, id_column)

    ordered = source.repartitionByRange(F.col(id_column)).sortWithinPartitions(id_column)
    return folder, materialize(ordered.mapInArrow(run, MANIFEST), "token-manifest")


class Shard:
    """Reads one shard; ``document(i)`` fetches one frame."""

    def __init__(self, file: str, size: int | None = None):
        import zstandard

        system, path = pyarrow.fs.FileSystem.from_uri(file)
        self.source = system.open_input_file(path)
        size = self.source.size()
        place, length, docs, digest, magic = struct.unpack(FOOTER, self.source.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{file} is no token shard")
        with system.open_input_file(f"{path.rsplit('/', 1)[0]}/{digest.hex()}.dictionary") as stored:
            dictionary = stored.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{file}: its dictionary has changed")
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.expand = zstandard.ZstdDecompressor(dict_data=held)
        self.width = self.source.read_at(1, len(MAGIC))[0]
        self.index = np.frombuffer(self.expand.decompress(self.source.read_at(length, place)), "<i8").reshape(docs, 4)
        self.limits = np.concatenate((self.index[:, 2], [place]))

    def document(self, i: int) -> np.ndarray:
        frame = self.source.read_at(int(self.limits[i + 1] - self.limits[i]), int(self.limits[i]))
        return np.frombuffer(self.expand.decompress(frame), f"<u{self.width}").astype("<u4")


def read_store(manifest: DataFrame, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Rows of a store: id, start (ids of all documents before it), n_tokens, ids_crc32[, ids]."""
    names = [id_column, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = f"`{id_column}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(file)
                known, doc, _, counts = shard.index.T
                starts = base + np.cumsum(counts) - counts
                for low in range(0, len(doc), 2048):
                    high = min(low + 2048, len(doc))
                    ids = [shard.document(i) for i in range(low, high)]
                    columns = [
                        pa.array(doc[low:high], pa.int64(), mask=known[low:high] == 0),
                        pa.array(starts[low:high], pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.select("shard", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return placed.repartition("shard").mapInArrow(run, schema)


def fetch(spark: SparkSession, manifest: DataFrame, doc_id: int) -> np.ndarray | None:
    """Ids of one document by its offset index, without reading any other document."""
    for row in manifest.orderBy("shard").toLocalIterator():
        shard = Shard(row.file)
        found = np.flatnonzero((shard.index[:, 0] == 1) & (shard.index[:, 1] == doc_id))
        if len(found):
            return shard.document(int(found[0]))
    return None
