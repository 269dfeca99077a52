"""Token ids in files: one compressed frame per document, a shared dictionary.

A file set is a folder with two Parquet tables, written by Spark so that any
store works and a lost task leaves nothing behind:

``blocks``      shard, block, first_start, dictionary_hash, payload, and the
                offset index of the block: doc_ids, offsets, n_tokens
``dictionary``  hash and bytes of the zstandard dictionary, id width

Shards are ranges of doc_id in ascending order, blocks are in order within a
shard, and each document in a block is a zstandard frame of its own, so a short
document is read by slicing one frame out of its block. Starts within a shard
are in the file; a shard's own start is the sum of those before it (one number
a shard).

Nulls, empties, repeats: a null or empty text holds the end id alone; a null
doc_id sorts first; rows that share a doc_id are kept, in the order of their
ids' checksum, then length (rows alike in both, ties, are alike in all that is written); a very long text is
encoded whole, as one frame; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftspark.llm import tokens
from shiftspark.llm.common import byte_slices, hash_sample, new_path, stash, table, tidied

#: The dictionary is trained on the ids of at most so many documents, in at most so many pieces of so many ids.
SAMPLE_DOCUMENTS = 400
SAMPLE_PIECES = 4_000
SAMPLE_IDS = 512
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
BLOCK_BYTES = 1 << 20

BLOCKS = "shard int, block int, first_start long, n_tokens_block long, dictionary_hash string, payload binary, doc_ids array<long>, offsets array<int>, n_tokens array<long>"


def train_dictionary(docs: DataFrame, vocabulary: str, width: str) -> bytes:
    """From the ids of a bounded sample; empty where that is too small to train on.

    Documents are picked by a hash of their ids, cut into pieces whole, as short
    ones gain the most, and the pieces picked by a hash again.
    """
    import zstandard

    picked = hash_sample(docs.select("doc_id").where("doc_id is not null").distinct(), SAMPLE_DOCUMENTS, "doc_id")
    texts = docs.join(F.broadcast(picked), "doc_id").select("text")  # at most SAMPLE_DOCUMENTS ids

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        for batch in batches:
            for first, n in byte_slices(batch.column(0), tokens.SLICE_BYTES):
                flat, count = enc.encode(batch.column(0).slice(first, n))
                flat, ends = flat.astype(width), np.cumsum(count)
                cut = [flat[k : min(b, k + SAMPLE_IDS)].tobytes() for a, b in zip((ends - count).tolist(), ends.tolist()) for k in range(a, b, SAMPLE_IDS)]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["ids"])

    cut = stash(texts.mapInArrow(run, "ids binary"), "dictionarysample")
    samples = sorted(bytes(r["ids"]) for r in hash_sample(cut, SAMPLE_PIECES, "ids").collect())
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _boundaries(docs: DataFrame, shards: int) -> list[int]:
    """doc_ids that split the rows into about equal ranges; reads doc_id only."""
    at = [i / shards for i in range(1, shards)]
    got = docs.agg(F.percentile_approx("doc_id", at, 10_000).alias("b")).first()["b"] if at else None
    return sorted(set(got or []))


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, shards: int | None = None) -> None:
    """Encode every text, append the end id, and write the file set to ``path``."""
    import zstandard

    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    width = "<u2" if len(tokens.encoder(vocabulary).ends_word) <= 1 << 16 else "<u4"
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(_boundaries(docs, shards), np.int64)
    trained = train_dictionary(docs, vocabulary, width)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(name, trained, width, tokens.END_ID)], "hash string, bytes binary, width string, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")

    def compressor():
        if not trained:
            return zstandard.ZstdCompressor(level=LEVEL).compress
        shared = zstandard.ZstdCompressionDict(trained)
        shared.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=shared).compress

    @tidied

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, compress = tokens.encoder(vocabulary), compressor()
        for batch in batches:
            for first, n in byte_slices(batch.column(1), tokens.SLICE_BYTES):
                doc_ids = batch.column(0).slice(first, n)
                flat, count = enc.encode(batch.column(1).slice(first, n))
                small, end, a, out, crc = flat.astype(width), np.array([tokens.END_ID], width).tobytes(), 0, [], []
                for k in count.tolist():
                    raw = small[a : a + k].tobytes() + end
                    out.append(compress(raw))
                    crc.append(zlib.crc32(raw))
                    a += k
                filled = np.asarray(doc_ids.fill_null(np.iinfo(np.int64).min))
                shard = np.searchsorted(bounds, filled, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(shard), pa.array(count + 1), pa.array(crc, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "shard", "n", "crc", "frame"])

    @tidied

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"shard": None}

        def flush():
            if state["shard"] is not None and state["frames"]:
                sizes = [len(f) for f in state["frames"]]
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                total = sum(state["n"])
                row = {"shard": state["shard"], "block": state["block"], "first_start": state["start"], "n_tokens_block": total, "dictionary_hash": name, "payload": b"".join(state["frames"]), "doc_ids": state["ids"], "offsets": offsets.tolist(), "n_tokens": state["n"]}
                state.update(block=state["block"] + 1, start=state["start"] + total, frames=[], ids=[], n=[], bytes=0)
                return pa.RecordBatch.from_pylist([row], _BLOCK_SCHEMA)
            return None

        for batch in batches:
            for doc_id, shard, n, frame in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if shard != state["shard"] or state["bytes"] >= BLOCK_BYTES:
                    if (got := flush()) is not None:
                        yield got
                    if shard != state["shard"]:
                        state.update(shard=shard, block=0, start=0, frames=[], ids=[], n=[], bytes=0)
                state["frames"].append(frame)
                state["ids"].append(doc_id)
                state["n"].append(n)
                state["bytes"] += len(frame)
        if (got := flush()) is not None:
            yield got

    (
        docs.mapInArrow(frames, "doc_id long, shard int, n long, crc long, frame binary")
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions("doc_id", "crc", "n")
        .mapInArrow(blocks, BLOCKS)
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )


_BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_start", pa.int64()), ("n_tokens_block", pa.int64()), ("dictionary_hash", pa.string()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int64()))])


def read_ids(spark: SparkSession, path: str, with_ids: bool = True, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents of a file set: doc_id, start, n_tokens, ids_crc32 (and ids).

    With ``doc_ids``, only the blocks that hold one of them are read whole, and
    only those documents' frames are opened.
    """
    import zstandard

    shared = spark.read.parquet(f"{path}/dictionary").first()
    trained, width, name = bytes(shared["bytes"]), shared["width"], shared["hash"]
    files = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = files.groupBy("shard").agg(F.sum("n_tokens_block").alias("n"))
    # One row a shard, and shards are as many as the writer was told, so the payloads stay where they are.
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    if doc_ids is not None:
        wanted = F.array(*[F.lit(i).cast("long") for i in doc_ids])
        files = files.where(F.arrays_overlap("doc_ids", wanted))
    only = set(doc_ids) if doc_ids is not None else None

    @tidied

    def open_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != name:
                    raise ValueError("this block was written with another dictionary")
                start, out = row["before"] + row["first_start"], []
                for doc_id, n, a, b in zip(row["doc_ids"], row["n_tokens"], row["offsets"], row["offsets"][1:]):
                    if only is None or doc_id in only:
                        ids = np.frombuffer(plain.decompress(row["payload"][a:b]), width).astype("<u4")
                        out.append((doc_id, start, len(ids), zlib.crc32(ids), ids.astype(np.int64) if with_ids else None))
                    start += n
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                    k = 5 if with_ids else 4
                    yield pa.RecordBatch.from_arrays(columns[:k], names[:k])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return files.join(F.broadcast(before), "shard").select("before", "first_start", "dictionary_hash", "payload", "doc_ids", "offsets", "n_tokens").mapInArrow(open_frames, schema)


def op5_token_id_files(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path, with_ids=False)
