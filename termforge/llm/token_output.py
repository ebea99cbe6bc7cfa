"""Token-id output: ids ranked by frequency, in byte-aligned variable-length coding.

A file is a table of blocks. A block holds whole documents in ascending doc_id order: their ids are
replaced by their rank among all ids (the most frequent is 0), each rank takes 1 to 4 bytes in `data`, and
`control` holds the byte counts apart, two bits each, four to a byte. numpy decodes a block by looking each
control byte up in a table of 256 rows. Files of one id range share a folder `part=N`; the folders, the blocks
in them by `block`, and the documents in a block are in order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.llm.common import documents, partitions, shared_dir, stored, table
from termforge.llm.tokens import TOKENIZER, PieceEncoder, encoder_for, gathered, small_batches, with_end

END = 2
#: Ids in a block, about; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
#: Stands for a missing doc_id in a block.
NO_ID = -(1 << 63)
#: Byte counts of four ids by control byte.
TABLE = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_IDS = "part int, seq bigint, at bigint, doc_id bigint, ids binary, counts binary"
_FILE = "part int, block bigint, at bigint, n_docs bigint, n_ids bigint, doc_ids binary, lengths binary, control binary, data binary"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative ranks below 2^32."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    four[: len(ranks)] = extra
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    kept = np.arange(4) <= extra[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse of encode_ranks, by table lookup."""
    sizes = TABLE[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    source = np.frombuffer(data, np.uint8)
    ranks = source[starts].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        ranks[more] |= source[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def token_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """part, seq, at, doc_id, ids (binary, little-endian, 2 or 4 bytes each), ascending by part and doc_id.

    seq numbers the rows of a part, and at counts the ids before a row in its part. Last comes a row without part
    whose `counts` has the number of times that the part has each id.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        counts = np.zeros(encoder.tokenizer.get_vocab_size() + end + 1, np.int64)
        seq = at = 0
        rows = (r for b in batches for r in zip(zip(b["part"].to_pylist(), b["doc_id"].to_pylist()), b["text"].to_pylist()))
        for group in gathered(rows):
            ids, lengths = with_end(*encoder.encode([t for _, t in group], sentences=False)[:2], end)
            found = np.bincount(ids)
            counts[: len(found)] += found
            raw = ids.astype(f"<u{encoder.width}")
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in group], pa.int32()), pa.array(seq + np.arange(len(group))), pa.array(at + cuts[:-1]), pa.array([k[1] for k, _ in group], pa.int64()), pa.array([raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()), pa.nulls(len(group), pa.binary())],
                names=[x.split()[0] for x in _IDS.split(", ")],
            )
            seq, at = seq + len(group), at + int(cuts[-1])
        if seq:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int32(), *[pa.int64()] * 3, pa.binary())), pa.array([counts.tobytes()], pa.binary())], names=[x.split()[0] for x in _IDS.split(", ")])

    ranged = documents(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    return ranged.mapInArrow(run, _IDS)


def rank_ids(ids: DataFrame, size: int) -> np.ndarray:
    """The rank of every id of the vocabulary by its count over all rows; ties by id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for raw in b["counts"].to_pylist():
                counts += np.frombuffer(raw, np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    tables = ids.select("counts").where("counts IS NOT NULL").coalesce(ids.sparkSession.sparkContext.defaultParallelism)  # a row a part
    for row in tables.mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id at most
        counts[row["id"]] = row["n"]
    ranks = np.empty(size, np.int64)
    ranks[np.lexsort((np.arange(size), -counts))] = np.arange(size)
    return ranks


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END) -> None:
    """Encode every document and write token files under path/ids, and the ranked ids under path/ranks.

    Null text is empty and has the end id alone. Rows with one doc_id are written one after another, by text;
    rows without doc_id come first. An empty table gives no blocks. Extra columns are ignored.
    """
    spark = docs.sparkSession
    encoder = PieceEncoder(tokenizer)
    width, size = encoder.width, encoder.tokenizer.get_vocab_size() + end + 1
    ids = stored(token_ids(docs, tokenizer, end), "ids", compression="zstd")
    ranks = rank_ids(ids, size)
    spark.createDataFrame([(np.argsort(ranks).astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(ranks)  # as long as the vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = shared.value.astype("<u4")
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            found = ranked[np.frombuffer(b"".join(x[4] for x in held), f"<u{width}")]
            control, data = encode_ranks(found)
            lengths = np.array([len(x[4]) // width for x in held], "<i8")
            named = np.array([NO_ID if x[3] is None else x[3] for x in held], "<i8")
            row = [*held[0][:3], len(held), len(found), named.tobytes(), lengths.tobytes(), control, data]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 4])], names=[x.split()[0] for x in _FILE.split(", ")])

        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("part", "seq", "at", "doc_id", "ids"))):
                if held and (size + len(row[4]) > BLOCK_IDS * width or row[0] != held[0][0] or row[1] != held[-1][1] + 1):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield block()

    ids.where("part IS NOT NULL").drop("counts").mapInArrow(write, _FILE).sortWithinPartitions("part", "block").write.partitionBy("part").option("compression", "none").parquet(f"{path}/ids")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode token files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (both of 32-bit little-endian ids)."""
    blocks = spark.read.schema(_FILE).parquet(f"{path}/ids")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("all"))  # a row an id range
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    ranked = spark.read.parquet(f"{path}/ranks").first()["ids"]
    table_ = spark.sparkContext.broadcast(ranked)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = np.frombuffer(table_.value, "<u4")
        for b in batches:
            for start, n, named, lengths, control, data in zip(*(b[c].to_pylist() for c in ("start", "n_ids", "doc_ids", "lengths", "control", "data"))):
                ids = by_rank[decode_ranks(control, data, n)]
                lengths = np.frombuffer(lengths, "<i8")
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                named = np.frombuffer(named, "<i8")
                raw = memoryview(ids.astype("<u4")).cast("B")
                each = [raw[4 * a : 4 * z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                columns = [pa.array(named, pa.int64(), mask=named == NO_ID), pa.array(cuts[:-1] + start), pa.array(lengths), pa.array(list(map(zlib.crc32, each)), pa.int64())]
                if with_ids:
                    columns.append(pa.array(list(map(bytes, each)), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("at") + F.col("before")).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/termforge/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, with_ids=False)
