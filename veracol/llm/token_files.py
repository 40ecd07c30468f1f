"""Token ids in Arrow files of fixed-size-list batches.

A file holds record batches of two columns: ``ids``, fixed-size lists of one integer width, and
``mask``, fixed-size lists of bits that are false on the padding of the last sequence. Values of a
batch lie in one buffer, so ``SequenceFile`` hands out any sequence or mask of a mapped file without a
copy. The schema's metadata carries the documents of the file as an Arrow stream of (doc_id,
n_tokens); a document is never split between files.

Writing: rows are dealt by ranges of (id, hash of the text) and sorted, so files in order of (part,
number) hold the documents in ascending id order; null ids come first, and rows that share an id are
told apart by their texts. A task writes each file under a name of its own attempt and returns it in a
manifest; only files of the manifest are ever read, so repeated or lost attempts do no harm. Files go
to a folder that executors share, through the file system its address names.

Null and empty texts are one end id. Repeated rows are each written.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veracol.session import scratch_path

from .shared import cut, text_bytes

SEQUENCE = 2048
FILE_TOKENS = 1 << 23
SEQUENCES_A_BATCH = 256
_CACHED = 400_000
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD_END = re.compile(rb"(?:[A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")  # a letter or digit of ASCII or Latin-1


class WordCache:
    """Ids of texts from those of their parts between ASCII blanks.

    Only for tokenizers that drop white space and split at it, whatever stands around, and part letters and digits from marks: their ids of a
    text are those of its parts in a row, whatever the case of parts that are ASCII throughout. The parts of a batch are looked up once for each
    different one; those not seen lately are encoded together. The cache has two halves of _CACHED / 2 parts: what is found in the older one moves to the newer,
    and when that is full it becomes the older one, so the cache holds _CACHED parts and those of one batch at most.
    """

    def __init__(self, path: str, code: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.code, self.known, self.older = Tokenizer.from_file(path), code, {}, {}

    @staticmethod
    def _lowered(data: bytes) -> bytes:
        # the tokenizer drops case itself; only its special tokens, which hold "<|", are found before.
        # It composes characters before it drops case, and some compose in lower case only: parts beyond ASCII keep their case, but for
        # texts below U+0100, in which nothing is composed.
        if b"<|" in data:
            return data
        if data.isascii():
            return data.lower()
        try:
            text = data.decode()
            text.encode("latin-1")
            return text.lower().encode()
        except UnicodeError:
            return b" ".join([p.lower() if p.isascii() else p for p in data.split()])

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Each part's ids, as the bytes of an array."""
        if len(self.known) > _CACHED // 2:
            self.known, self.older = {}, self.known
        known = self.known
        fresh = self._recalled(parts)
        # marks at the end of a part are a part of their own
        cores = [p if b"<|" in p else p.rstrip(_MARKS) for p in fresh]
        ended = [(c, p[len(c) :]) for c, p in zip(cores, fresh, strict=True) if c and len(c) < len(p) and _WORD_END.search(c)]
        whole = {c + t for c, t in ended}
        new = self._recalled({*(p for p in fresh if p not in whole), *(x for pair in ended for x in pair)})
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            known.update((word, array(self.code, e.ids).tobytes()) for word, e in zip(part, found, strict=True))
        known.update((c + t, known[c] + known[t]) for c, t in ended)
        return list(map(known.__getitem__, parts))

    def _recalled(self, parts: Iterable[bytes]) -> list[bytes]:
        """Those of the parts that neither half holds; the older half's move to the newer."""
        known, older = self.known, self.older
        missed = [p for p in parts if p not in known]
        known.update((p, older[p]) for p in missed if p in older)
        return [p for p in missed if p not in older]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Each text's ids, as the bytes of an array."""
        parted = pc.ascii_split_whitespace(pa.array([self._lowered(data) for data in texts], pa.binary()).view(pa.string()))
        parts = parted.flatten().dictionary_encode()
        ids = self._ids(parts.dictionary.view(pa.binary()).to_pylist())
        ends = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))] // array(self.code).itemsize
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), self.code)))
        row = lists.take(parts.indices).flatten().to_numpy()
        places = np.r_[0, np.cumsum(np.diff(ends)[parts.indices.to_numpy()])][parted.offsets.to_numpy()].tolist()
        for a, b in zip(places[:-1], places[1:], strict=True):
            yield row[a:b].tobytes()


@lru_cache(maxsize=2)
def word_cache(path: str, code: str) -> WordCache:
    return WordCache(path, code)


def id_code(path: str) -> str:
    """Array type code of the narrowest unsigned integer that holds a tokenizer's ids."""
    from tokenizers import Tokenizer

    return "H" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "I"


def file_bytes(ids: np.ndarray, documents: pa.RecordBatch, sequence: int = SEQUENCE) -> bytes:
    """One file of all ids in order, the last sequence padded with zeros."""
    rows = -(-len(ids) // sequence)
    values = np.zeros(rows * sequence, ids.dtype)
    values[: len(ids)] = ids
    mask = np.zeros(rows * sequence, bool)
    mask[: len(ids)] = True
    index = io.BytesIO()
    with pa.ipc.new_stream(index, documents.schema) as out:
        out.write_batch(documents)
    kind = pa.from_numpy_dtype(ids.dtype)
    schema = pa.schema([pa.field("ids", pa.list_(kind, sequence)), pa.field("mask", pa.list_(pa.bool_(), sequence))], metadata={"documents": index.getvalue(), "n_tokens": str(len(ids))})
    sink = io.BytesIO()
    with pa.ipc.new_file(sink, schema) as out:
        for at in range(0, rows, SEQUENCES_A_BATCH):
            part = slice(at * sequence, min(rows, at + SEQUENCES_A_BATCH) * sequence)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), sequence) for x in (values, mask)]
            out.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema))
    return sink.getvalue()


class SequenceFile:
    """Random access to the sequences of a file given as a buffer or a local path, which is mapped."""

    def __init__(self, source):
        self.reader = pa.ipc.open_file(pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source))
        self.schema = self.reader.schema
        self.n_tokens = int(self.schema.metadata[b"n_tokens"])
        self.sequence = self.schema.field("ids").type.list_size
        self.batches = [self.reader.get_batch(i) for i in range(self.reader.num_record_batches)]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _values(self, column: int, i: int) -> pa.Array:
        batch = self.batches[i // SEQUENCES_A_BATCH].column(column)
        return batch.values.slice((batch.offset + i % SEQUENCES_A_BATCH) * self.sequence, self.sequence)

    def ids(self, i: int) -> np.ndarray:
        """Sequence i, a view of the file."""
        return self._values(0, i).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.Array:
        """Mask of sequence i, a view of the file's bits."""
        return self._values(1, i)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range, without padding; a view where the range lies in one batch."""
        size = SEQUENCES_A_BATCH * self.sequence
        parts = [self.batches[b].column(0).values.to_numpy()[max(0, start - b * size) : stop - b * size] for b in range(start // size, -(-stop // size))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def documents(self) -> pa.RecordBatch:
        return pa.ipc.open_stream(self.schema.metadata[b"documents"]).read_next_batch()


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write all documents below ``root``; returns the manifest (part, number, name, n_documents, n_tokens)."""
    code = id_code(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get(), 0
        store, folder = pa.fs.FileSystem.from_uri(root)
        encode = word_cache(tokenizer, code).encode
        held, ids, sizes = array(code), [], []

        def flush():
            nonlocal held, ids, sizes, number
            name = f"{task.partitionId():06d}-{number:05d}-{task.attemptNumber()}-{uuid.uuid4().hex}.arrow"
            index = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(file_bytes(np.frombuffer(held, np.uint16 if code == "H" else np.uint32), index, sequence))
            row = pa.RecordBatch.from_pydict({"part": [task.partitionId()], "number": [number], "name": [name], "n_documents": [len(sizes)], "n_tokens": [len(held)]})
            held, ids, sizes, number = array(code), [], [], number + 1
            return row

        for batch in batches:
            keys, start = batch.column("row_id"), 0
            for at, tokens in enumerate(encode(batch.column("data").to_pylist())):
                held.frombytes(tokens)
                held.append(end_id)
                sizes.append(len(tokens) // held.itemsize + 1)
                if len(held) >= file_tokens:
                    ids.append(keys.slice(start, at + 1 - start))
                    start = at + 1
                    yield flush()
            ids.append(keys.slice(start))
        if sizes:
            yield flush()

    pa.fs.FileSystem.from_uri(root)[0].create_dir(pa.fs.FileSystem.from_uri(root)[1], recursive=True)
    rows = docs.select(F.col(id_column).alias("row_id"), text_bytes(text).alias("data")).withColumn("tie", F.xxhash64("data"))
    dealt = rows.repartitionByRange("row_id", "tie").sortWithinPartitions("row_id", "tie", "data").select("row_id", "data")
    return cut(dealt.mapInArrow(run, "part bigint, number bigint, name string, n_documents bigint, n_tokens bigint"))


def read_token_files(spark: SparkSession, root: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """From the files of the manifest: a row (doc_id, start, n_tokens, ids_crc32) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                file = SequenceFile(content.as_buffer())
                documents = file.documents()
                sizes = documents.column("n_tokens").to_numpy()
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(file.tokens(a, b).astype("<u4").tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(sizes)), documents.column("doc_id"), pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], names=["name", "doc_id", "at", "n_tokens", "ids_crc32"])

    part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    first = manifest.select("name", "part", F.coalesce(within, F.lit(0)).alias("within")).join(part, "part").select("name", (F.coalesce("before", F.lit(0)) + F.col("within")).alias("first"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    read = files.mapInArrow(run, f"name string, doc_id {id_type}, at bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(first, "name").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """Write the documents to files in the shared scratch folder and read them back."""
    spark = docs.sparkSession
    root = scratch_path(spark, "tokens")
    manifest = write_token_files(docs, root, tokenizer, end_id, id_column, text, **sizes)
    return read_token_files(spark, root, manifest, docs.schema[id_column].dataType.simpleString())
