"""Token ids of all documents in binary files of fixed-width ids, in ascending order of document ids.

1. documents are range-partitioned by id and sorted inside the ranges (one shuffle of the texts);
2. each task encodes its texts and writes one file of :mod:`idfile` into the shared folder, under a name of its own
   for every attempt; the names that count are those in the manifest, a Parquet table which Spark commits, so a task that
   is run again or twice leaves at most a file that nobody reads;
3. running sums over the manifest give the ids that lie before each file; readers seek through the files by their index.

Encoding words one at a time is exact for a tokenizer that drops white space and never lets a token go over it
(``by_word``): then each task encodes a word once and copies its ids afterwards.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm import idfile
from trailspark.llm.common import map_texts, materialize, shared_folder

# Bytes of text in one file, and files at least (per core).
FILE_BYTES = 64 << 20
FILES_PER_CORE = 3
# Words whose ids one Python worker keeps; beyond that it starts anew.
CACHE_WORDS = 1_000_000

# Letters whose lower case, normal form and kind are the same in every Unicode version: ASCII and Latin-1.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: itself where it is printable, else the next free character from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class _Numbers(dict):
    """Numbers words as they come; ``new`` lists those not yet encoded."""

    def __missing__(self, word):
        k = self[word] = len(self)
        self.new.append(word)
        return k


class WordEncoder:
    """Ids of whole texts from the ids of their words, which are encoded once.

    A word of plain letters goes straight to the tokenizer's merges, many words in one call: its ids end with the one
    id of a piece that stands at a word's end.  All other words go through the whole tokenizer one by one.
    """

    def __init__(self, json: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok, self.end_id = Tokenizer.from_str(json), end_id
        self.merges = Tokenizer(self.tok.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tok.get_vocab()
        self.suffix = self.tok.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if self.suffix and t.endswith(self.suffix)]] = True
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.clear()

    def clear(self) -> None:
        """Forget all words; number 0 is a document's end."""
        self.numbers = _Numbers({None: 0})
        self.numbers.new = []
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.values, self.used = np.zeros(4096, np.uint32), 0
        self._store(np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end_id], np.uint32))

    def _store(self, numbers: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> None:
        """Ids of words: those of ``numbers``, one after another."""
        while len(self.numbers) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(values) > len(self.values):
            self.values = np.resize(self.values, 2 * len(self.values))
        self.length[numbers], self.start[numbers] = lengths, self.used + np.cumsum(lengths) - lengths
        self.values[self.used:self.used + len(values)] = values
        self.used += len(values)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words, one after another, and how many there are up to each."""
        lengths = self.length[numbers]
        after = np.cumsum(lengths)
        total = int(after[-1]) if len(after) else 0
        return self.values[np.repeat(self.start[numbers] - (after - lengths), lengths) + np.arange(total)], after

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        some = " ".join([w if w.isascii() else w.translate(self.letters) for w in words])
        ids = np.array(self.merges.encode(some, add_special_tokens=False).ids, np.uint32)
        after = np.flatnonzero(self.ends[ids]) + 1
        return (np.diff(after, prepend=0), ids) if len(after) == len(words) else self._each(words)

    def _learn(self) -> None:
        """Ids of all new words; a word of letters and stops takes those of its lower-case letters and of its stops."""
        numbers, new = self.numbers, self.numbers.new
        units: dict[bool, list] = {True: [], False: []}  # (word, number) that are encoded, by whether they are plain letters
        joined, letters, stops = [], [], []  # numbers of words, and of their two parts (0: none)
        k, first = 0, len(numbers) - len(new)
        while k < len(new):  # parts that are new go to the end of the list
            words = b"\n".join(new[k:]).decode("utf-8", "replace").split("\n")
            for number, word in enumerate(words, first + k):
                m = PLAIN.fullmatch(word)
                if m is None:
                    units[False].append((word, number))
                    continue
                stem, tail = m.groups()
                low = stem.lower()
                if not tail and low == word:
                    units[True].append((word, number))
                    continue
                joined.append(number)
                letters.append(numbers[low.encode()])
                stops.append(numbers[tail.encode()] if tail else 0)
            k += len(words)
        for plain, size in ((True, 1000), (False, 10_000)):
            encode = self._plain if plain and self.suffix else self._each
            for k in range(0, len(units[plain]), size):
                words, at = zip(*units[plain][k:k + size], strict=True)
                self._store(np.array(at, np.int64), *encode(words))
        if joined:
            at, parts = np.array(joined, np.int64), np.array([letters, stops], np.int64)
            lengths = self.length[parts] * (parts > 0)
            pairs = parts.T.ravel()
            self._store(at, lengths.sum(axis=0), self._gather(pairs[pairs > 0])[0])
        self.numbers.new = []

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        if len(self.numbers) > CACHE_WORDS:
            self.clear()
        flat: list = []
        ends = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            flat += (text or b"").split()
            flat.append(None)
            ends[k] = len(flat)
        number = np.fromiter(map(self.numbers.__getitem__, flat), np.int64, len(flat))
        if self.numbers.new:
            self._learn()
        ids, after = self._gather(number)
        return np.split(ids, after[ends - 1][:-1]) if texts else []


class TextEncoder:
    """Ids of whole texts by the tokenizer as it is."""

    def __init__(self, json: str, end_id: int):
        from tokenizers import Tokenizer
        self.tok, self.end_id = Tokenizer.from_str(json), end_id

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        out = self.tok.encode_batch_fast([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array([*e.ids, self.end_id], np.uint32) for e in out]


_encoders: dict = {}  # of this Python worker, which runs many tasks


def encoder(json: str, end_id: int, by_word: bool):
    key = (zlib.crc32(json.encode()), len(json), end_id, by_word)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = (WordEncoder if by_word else TextEncoder)(json, end_id)
    return _encoders[key]


def _split(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[list, list]]:
    """Documents of a batch, about ``most`` bytes of text at a time."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        ids.append(i)
        texts.append(t)
        size += len(t or b"")
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_ids(docs: DataFrame, tokenizer_json: str, end_id: int, doc_id: str = "doc_id", text: str = "text", by_word: bool = False,
              file_bytes: int = FILE_BYTES, block: int = idfile.BLOCK, folder: str | None = None) -> DataFrame:
    """Writes the ids of all texts of ``docs`` and returns the manifest: ``part, path, n_docs, n_ids, first`` (ids before the file).

    Ids are stored in the bits that the vocabulary (the end id included) needs.  Files and documents in them are in ascending
    order of ``doc_id``; rows without an id come last, rows of one id by a hash of the text and then as they are read.  A null text is
    empty: its document is the end id alone.  An empty table has no file.  Other columns are not read.  ``by_word``: see the module.
    """
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    width = idfile.width_of(max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1))
    folder = folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)
    folder = store.makeQualified(where).toString()

    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(-(-total // file_bytes), FILES_PER_CORE * spark.sparkContext.defaultParallelism)
    order = [F.col("id").asc_nulls_last(), F.col("tie"), F.col("row")]
    # rows of one id can be split between files by their number
    dealt = (narrow.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
             .repartitionByRange(files, *order).sortWithinPartitions(*order).select("id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), None
        encode = encoder(tokenizer_json, end_id, by_word).encode
        for batch in batches:
            for ids, texts in _split(batch):
                if out is None:
                    path = f"{folder}/part-{part:07d}-{uuid.uuid4().hex}.ids"
                    files, at = pa.fs.FileSystem.from_uri(path)
                    out = idfile.Writer(files.open_output_stream(at), width, block)
                for i, x in zip(ids, encode(texts), strict=True):
                    out.add(i, x)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": len(out.docs), "n_ids": out.ids}], schema)

    schema = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    written = materialize(map_texts(dealt, write, "part long, path string, n_docs long, n_ids long"))
    return materialize(running_start(written))


def running_start(manifest: DataFrame, group: int = 1024) -> DataFrame:
    """``manifest`` with ``first``, the sum of ``n_ids`` of all smaller parts: inside groups of parts, then over the groups."""
    g = F.floor(F.col("part") / group)
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = manifest.groupBy(g.alias("g")).agg(F.sum("n_ids").alias("n_ids"))
    groups = groups.select("g", before(Window.orderBy("g")).alias("__before"))
    inside = manifest.withColumn("g", g).withColumn("first", before(Window.partitionBy("g").orderBy("part")))
    return inside.join(groups, "g").withColumn("first", F.col("first") + F.col("__before")).drop("g", "__before")


def read_ids(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``
    (of all its ids as little-endian 32-bit numbers).  A file is read block by block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, at = pa.fs.FileSystem.from_uri(row["path"])
                with files.open_input_file(at) as stream:
                    f = idfile.Reader(stream)
                    crc = np.zeros(len(f.doc_ids), np.int64)
                    for k, ids in f.stretches():
                        crc[k] = zlib.crc32(ids.astype("<u4").tobytes(), int(crc[k]))
                n = len(crc)
                out = pa.RecordBatch.from_arrays([
                    pa.array(f.doc_ids, mask=f.nulls), pa.array(f.starts[:-1] + row["first"]), pa.array(np.diff(f.starts)), pa.array(crc)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])
                yield from (out.slice(k, 10_000) for k in range(0, n, 10_000))

    files = manifest.count()
    some = manifest.select("part", "path", "first").repartition(max(1, files), "part")
    return some.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
