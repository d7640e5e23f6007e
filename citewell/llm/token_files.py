"""Token ids of whole texts in Arrow files of fixed-size lists, for zero-copy access to equal-length sequences."""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewell.llm.byte_bpe import Known, gathered
from citewell.llm.common import cut, pieces, texts_of
from citewell.sources.tables import shared_dir

SEQUENCE = 1024
BATCH_SEQUENCES = 512
CACHED_WORDS = 1_000_000
WORDS_AT_ONCE = 200
BLANKS = str.maketrans("\t\n\r", "   ")


class Words:
    """The tokenizer file, applied to the parts of a text between blanks; parts that occur again are encoded once.

    Cutting at space, tab, line feed and carriage return changes nothing for a tokenizer that splits at white space and
    whose normaliser works within words. Strings of special tokens in a text, which hold no blanks, become their one id, as
    in the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        """The empty word is number 0 and has no ids."""
        self.known, self.ids, self.at = Known(), np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.known[""] = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        lookup = self.known.__getitem__
        places = []
        for text in texts:
            words = text.translate(BLANKS).split(" ") if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")
            places.append(np.fromiter(map(lookup, words), np.int64, len(words)))
        self._learn(self.known.new)
        self.known.new = []
        return [gathered(self.ids, self.at, place).astype("<u4").tobytes() for place in places]

    def _learn(self, new: list[str]) -> None:
        """Many words as one text, since each call costs more than a word does; ids are told apart by their places."""
        groups = [new[start : start + WORDS_AT_ONCE] for start in range(0, len(new), WORDS_AT_ONCE)]
        ids, counts = [self.ids], []
        for words, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ids.append(np.asarray(found.ids, np.uint32))
            begins = np.fromiter(itertools.chain.from_iterable(found.offsets), np.int64, 2 * len(ids[-1]))[::2]
            counts.append(np.diff(np.append(np.searchsorted(begins, np.cumsum(sizes) - sizes), len(begins))))
        self.ids = np.concatenate(ids)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))])


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


class SequenceWriter:
    """An Arrow file of (ids, mask) rows of ``SEQUENCE`` ids; ids run on from row to row, the last row is filled up."""

    def __init__(self, sink, length: int, n_ids: int):
        """``n_ids``: of the vocabulary; where all fit 16 bits, they take no more."""
        self.length, self.step = length, 4 * length * BATCH_SEQUENCES
        self.kind = np.dtype("<u2" if n_ids <= 2**16 else "<u4")
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting = bytearray()
        self.n = 0

    def add(self, ids: bytes) -> None:
        self.waiting += ids
        self.n += len(ids) // 4
        while len(self.waiting) >= self.step:
            self._write(bytes(self.waiting[: self.step]))
            del self.waiting[: self.step]

    def _write(self, ids: bytes) -> None:
        real = len(ids) // 4
        padded = np.zeros(-(-real // self.length) * self.length, self.kind)
        padded[:real] = np.frombuffer(ids, "<u4")
        mask = np.arange(padded.size) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._write(bytes(self.waiting))
        self.writer.close()


class SequenceFile:
    """Random access to a file: nothing is read but what is asked for, and from a local or mounted path nothing is copied."""

    def __init__(self, uri: str):
        system, path = arrow_fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(system, arrow_fs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _batch(self, i: int) -> pa.RecordBatch:
        if i != self.at:
            self.at, self.batch = i, self.reader.get_batch(i)
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the i-th sequence, as a view, and its mask, which takes a bit per id in the file."""
        batch, row = self._batch(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
        ids, mask = (batch.column(c).flatten().slice(row * self.length, self.length) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def spans(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from place ``start`` on, as one view for each batch that holds some."""
        whole = self.length * BATCH_SEQUENCES
        while n > 0:
            ids = self._batch(start // whole).column(0).flatten().to_numpy(zero_copy_only=True)
            part = ids[start % whole : start % whole + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, in ascending order of doc_id; return the written files.

    Rows are ranged over tasks by (doc_id, hash of the text), so neither many rows of one doc_id nor a hot source fill one
    task; a task writes one file of sequences and one of its documents. The result has a row for each file: part (files
    in order), uri, documents_uri, start (ids in all files before), n_ids. Names are new at every attempt and only those
    of finished attempts are returned, so a task that runs again leaves nothing wrong behind. NULL texts are empty and
    have the end id alone; NULL doc_ids come first; rows of one doc_id are ordered by the hash; empty input gives no file;
    other columns are left aside. ``folder`` must be one that all executors share.
    """
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    ordered = texts_of(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(path), np.asarray([end_id], "<u4").tobytes()
        system, root = arrow_fs.FileSystem.from_uri(_as_uri(folder))
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        uri = f"{folder}/{part:08d}-{name}.arrow"
        writer = sink = documents = doc_sink = None
        for batch in batches:
            for piece in pieces(batch, "text"):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    sink, doc_sink = system.open_output_stream(f"{root}/{part:08d}-{name}.arrow"), system.open_output_stream(f"{root}/{part:08d}-{name}.docs")
                    writer = SequenceWriter(sink, length, max(end_id + 1, words.tokenizer.get_vocab_size()))
                    documents = pa.ipc.new_file(doc_sink, pa.schema([("doc_id", piece.schema.field("doc_id").type), ("at", pa.int64()), ("n_tokens", pa.int64())]))
                at, n_tokens = [], []
                for ids in words.encode(piece.column("text").to_pylist()):
                    at.append(writer.n)
                    writer.add(ids)
                    writer.add(end)
                    n_tokens.append(writer.n - at[-1])
                documents.write_batch(pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(at, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "at", "n_tokens"]))
        if writer is not None:
            for x in (writer, sink, documents, doc_sink):
                x.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "uri": [uri], "documents_uri": [uri.removesuffix("arrow") + "docs"], "n_ids": pa.array([writer.n], pa.int64())})

    files = cut(ordered.select("doc_id", "text").mapInArrow(run, "part bigint, uri string, documents_uri string, n_ids bigint"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(files: DataFrame, doc_type: str = "bigint") -> DataFrame:
    """For each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = SequenceFile(_as_uri(row["uri"]))
                for docs in _document_rows(_as_uri(row["documents_uri"])):
                    crcs = []
                    for at, n in zip(docs.column("at").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                        crc = 0
                        for part in ids.spans(at, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        crcs.append(crc)
                    start = np.asarray(docs.column("at")) + row["start"]
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(start, pa.int64()), docs.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # As many tasks as files: the rows are small, and Spark would put them all in one.
    spread = files.select("uri", "documents_uri", "start").repartition(max(1, files.count()), "uri")
    return spread.mapInArrow(run, f"doc_id {doc_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def _as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _document_rows(uri: str) -> Iterator[pa.RecordBatch]:
    system, path = arrow_fs.FileSystem.from_uri(uri)
    reader = pa.ipc.open_file(system.open_input_file(path))
    for i in range(reader.num_record_batches):
        yield reader.get_batch(i)
