"""Token files: documents as token ids in independent rANS blocks, written and read by Spark.

A dataset is a folder with two Parquet tables, so that writes commit and retries of lost tasks leave nothing half done:
``tables`` (token, frequency; the shared frequency table) and ``blocks`` (file, block, n_docs, n_tokens, doc_ids, sizes,
payload). Files hold ascending ranges of the order, blocks follow each other inside a file, and a payload is a block of
``rans``: whole documents up to about ``BLOCK_TOKENS`` tokens (a longer document is a block of its own, which a reader
may enter at its checkpoints). Any block decodes on its own with the shared table.

Defined cases: null text is empty and an empty text is the end id alone; null ids are kept; repeated rows are repeated;
rows with equal order columns come in the order of a hash of their ids and texts; an empty table makes a dataset without
blocks; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actilens.llm.common import partitions, steps, stored, work_path
from actilens.llm.rans import Tables, decode, encode, frequencies
from actilens.llm.tokenizing import id_type, word_ids

BLOCK_TOKENS = 1 << 18
END_ID = 1
#: Text that is tokenised in one step; more means fewer distinct pieces to look up.
ENCODE_BYTES = 4 << 20
BLOCKS = "file long, block long, n_docs long, n_tokens long, doc_ids array<long>, sizes array<long>, payload binary"


def public_tokenizer(name: str) -> str:
    """The place of a public tokenizer file, which every executor has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, order: list[Column], tokenizer: str, end_id: int | None = END_ID) -> DataFrame:
    """``o`` (struct of the order columns), ``doc_id`` and ``ids`` (numbers of ``id_type``) for each row."""
    kind = np.dtype(id_type(tokenizer))
    names = [f"o{i}" for i in range(len(order))]
    key = F.struct(*[c.alias(n) for c, n in zip(order, names)], F.xxhash64("doc_id", "text").alias("tie"))
    rows = docs.select(key.alias("o"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = f"o {rows.schema['o'].dataType.simpleString()}, doc_id long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer, end_id)
        for batch in steps(batches, limit=ENCODE_BYTES):
            ids, sizes = encoder.encode(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(sizes * kind.itemsize)])
            data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("doc_id"), data], ["o", "doc_id", "ids"])

    return rows.mapInArrow(run, schema)


def batch_ids(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch and the n + 1 places where its documents begin."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def token_counts(rows: DataFrame, kind: str) -> dict[int, int]:
    """How often each token occurs: counted in every task, added up by Spark; as many entries as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in steps(batches, "ids"):
            ids, _ = batch_ids(batch.column("ids"), kind)
            mine = np.bincount(ids, minlength=len(counts))
            mine[: len(counts)] += counts
            counts = mine
        token = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(counts[token])], ["token", "n"])

    summed = rows.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in summed.collect()}


def _blocks(tables: Tables, limit: int, kind: str):
    """A task's rows, in order, as the blocks of one file."""

    def pack(number: int, ids: list[np.ndarray], docs: list, sizes: list[int]) -> pa.RecordBatch:
        tokens = np.concatenate(ids)
        kinds = {"file": pa.int64(), "block": pa.int64(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "payload": pa.binary()}
        values = (TaskContext.get().partitionId(), number, len(docs), len(tokens), docs, sizes, encode(tokens, tables))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, docs, sizes = 0, 0, [], [], []
        for batch in batches:
            tokens, starts = batch_ids(batch.column("ids"), kind)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), starts.tolist(), starts[1:].tolist()):
                if docs and held + b - a > limit:
                    yield pack(number, ids, docs, sizes)
                    number, held, ids, docs, sizes = number + 1, 0, [], [], []
                ids.append(tokens[a:b])
                docs.append(doc)
                sizes.append(b - a)
                held += b - a
        if docs:
            yield pack(number, ids, docs, sizes)

    return run


def write(
    docs: DataFrame, path: str, tokenizer: str, order: list[Column] | None = None, end_id: int | None = END_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> str:
    """Encode ``docs`` (``doc_id``, ``text``) in ascending ``order`` (the id) into a dataset at ``path``.

    Texts are tokenised once; the ids are stored, counted for the shared table, and sorted by range into files.
    """
    spark = docs.sparkSession
    rows = stored(encoded(docs, order or [F.col("doc_id")], tokenizer, end_id), "token-ids")
    counts = token_counts(rows, id_type(tokenizer))
    dense = np.zeros(max(counts, default=-1) + 1, np.int64)
    dense[list(counts)] = list(counts.values())
    freq = frequencies(dense)
    used = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(used, "token long, frequency long").coalesce(1).write.parquet(f"{path}/tables")
    in_order = rows.repartitionByRange(partitions(spark), "o").sortWithinPartitions("o").select("doc_id", "ids")
    in_order.mapInArrow(_blocks(Tables(freq), block_tokens, id_type(tokenizer)), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_tables(spark: SparkSession, path: str) -> Tables:
    """The shared table; as many rows as the vocabulary at most."""
    rows = spark.read.parquet(f"{path}/tables").collect()
    freq = np.zeros(max((r.token for r in rows), default=-1) + 1, np.uint32)
    freq[[r.token for r in rows]] = [r.frequency for r in rows]
    return Tables(freq)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block``, ``doc``, ``doc_id`` and ``ids`` (little-endian 32-bit numbers) of every document, each block
    decoded on its own and held against its checksum."""
    return _read(spark, path, keep_ids=True)


def _read(spark: SparkSession, path: str, keep_ids: bool) -> DataFrame:
    tables = read_tables(spark, path)
    last = "ids binary" if keep_ids else "before long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                raw = decode(row["payload"], tables).astype("<u4")
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                if len(raw) != (ends[-1] if len(ends) else 0):
                    raise ValueError("token block and document sizes differ")
                each = [raw[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
                n = len(each)
                columns = [pa.array([row["file"]] * n, pa.int64()), pa.array([row["block"]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(row["doc_ids"], pa.int64())]
                names = ["file", "block", "doc", "doc_id"]
                if keep_ids:
                    columns, names = [*columns, pa.array(each, pa.binary())], [*names, "ids"]
                else:
                    columns = [*columns, pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(b) for b in each], pa.int64())]
                    names += ["before", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns, names)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return blocks.select("file", "block", "doc_ids", "sizes", "payload").mapInArrow(run, f"file long, block long, doc long, doc_id long, {last}")


def index(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``block`` and ``start``, the number of ids before the block. Totals per file meet in one small window; the
    blocks of a file are added up on their own."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("file", "block", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n_tokens"))
    files = files.select("file", before(Window.orderBy("file")).alias("f"))
    inside = blocks.select("file", "block", before(Window.partitionBy("file").orderBy("block")).alias("b"))
    return inside.join(files, "file").select("file", "block", (F.col("f") + F.col("b")).alias("start"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, ``file``, ``block``."""
    found = _read(spark, path, keep_ids=False).join(index(spark, path), ["file", "block"])
    return found.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "block")


def file_order(docs: DataFrame) -> list[Column]:
    """The order in which the rows of a Parquet table lie in its files, files by their part number."""
    name = F.col("_metadata.file_name")
    return [F.length(name), name, F.col("_metadata.row_index")]


def written_rows(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", order: list[Column] | None = None) -> DataFrame:
    """The rows of query op3: documents written to a dataset in the shared folder and read back."""
    path = work_path(docs.sparkSession, "token-files")
    write(docs, path, public_tokenizer(tokenizer), order)
    return report(docs.sparkSession, path)
