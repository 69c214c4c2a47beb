"""Token ids in binary files, compressed block by block.

A token file is a folder of Parquet files; a row is a frame of whole documents
in ascending id order (nulls first, then ties by their ids' checksum), coded by
``coder.pack``. Columns: ``part`` and ``frame`` (their order), ``n_ids``,
``doc_ids`` and ``sizes`` (the documents, and how many ids each has), ``data``.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.llm import coder
from hitprism.llm.batches import map_batches, map_partitions, text_slices
from hitprism.llm.bpe import SLICE_BYTES, _encoder

#: A frame ends with the document that brings it to this many ids.
FRAME = 1 << 22

FRAMES = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("sizes", T.ArrayType(T.LongType())),
    T.StructField("data", T.BinaryType()),
])
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


class _Frames:
    def __init__(self, part):
        self.part, self.frame = part, 0
        self.clear()

    def clear(self):
        self.doc_ids, self.sizes, self.ids, self.n = [], [], [], 0

    def add(self, doc_ids, sizes, ids):
        """Takes documents; gives a row for each frame that they fill."""
        ends, done = np.cumsum(sizes), 0
        while done < len(sizes):
            start = int(ends[done - 1]) if done else 0
            full = int(np.searchsorted(ends, start + FRAME - self.n)) + 1
            until = min(full, len(sizes))
            self.doc_ids.extend(doc_ids[done:until])
            self.sizes.extend(sizes[done:until].tolist())
            self.ids.append(ids[start : int(ends[until - 1])])
            self.n += int(ends[until - 1]) - start
            done = until
            if self.n >= FRAME:
                yield self.row()

    def row(self):
        data = coder.pack(np.concatenate([*self.ids, np.zeros(0, np.int32)]))
        row = {"part": self.part, "frame": self.frame, "n_ids": self.n, "doc_ids": self.doc_ids,
               "sizes": self.sizes, "data": data}
        self.frame += 1
        self.clear()
        return row


def write_token_file(docs, path, tokenizer_json, end_id=None, doc_id="doc_id", text="text", apart=False):
    """Encode whole texts and write them; ``end_id`` is put after each document.

    ``tokenizer_json``: a tokenizer of the tokenizers library that drops white
    space and has ids below 65,536; ``apart`` as in ``bpe.Encoder``. A null text counts as empty; documents with
    equal or null ids stay apart. An empty table gives a file without frames.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches):
        encoder = _encoder(shared.value, False, apart)
        frames = _Frames(TaskContext.get().partitionId())
        for batch in batches:
            for rows in text_slices(batch, "text", SLICE_BYTES):
                ids, sizes = encoder(rows.column("text"))
                if end_id is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                for row in frames.add(rows.column("doc_id").to_pylist(), sizes, ids):
                    yield pa.RecordBatch.from_pylist([row], schema)
        if frames.doc_ids:
            yield pa.RecordBatch.from_pylist([frames.row()], schema)
        # the encoder keeps what it remembers: the worker goes on to tasks whose words are much the same

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    map_partitions(ordered, run, FRAMES).write.parquet(path)


def read_token_file(spark, path, keep_ids=True):
    """The documents of a token file: ``doc_id``, ``start`` (ids before it),
    ``n_tokens``, ``ids_crc32`` of its ids as little-endian 32-bit integers, and
    the ``ids`` (null unless ``keep_ids``). A damaged block fails the query."""
    frames = spark.read.schema(FRAMES).parquet(path)
    in_part = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = frames.select("part", "frame", "n_ids")
    # a row for each part, which is a task of the writer
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    starts = sizes.select("part", "frame", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("frame_start"))
    starts = starts.join(F.broadcast(parts), "part").select(
        "part", "frame", (F.col("part_start") + F.col("frame_start")).alias("start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batch):
        for row in range(batch.num_rows):
            ids = coder.unpack(batch.column("data")[row].as_py())
            n = batch.column("sizes")[row].values.to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
            start = batch.column("start")[row].as_py()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_ids")[row].values, pa.array(start + ends - n), pa.array(n), pa.array(sums, pa.int64()),
                lists if keep_ids else pa.nulls(len(n), pa.list_(pa.int32()))], schema=schema)

    return map_batches(frames.join(starts, ["part", "frame"]).select("doc_ids", "sizes", "data", "start"), run, DOCUMENTS)
