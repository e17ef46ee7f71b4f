"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are ranked by their count in the whole corpus; the rank is written in 1 to 4 bytes, little-endian, and a control
stream holds two bits an id (length minus one), four ids to a byte. Decoding looks four lengths up at once in a
256-row numpy table. One file holds a range of documents in ascending id order:

    magic 8 bytes | n_docs, n_ids, n_data (u64) | doc ids (i64) | null flags (u8) | ids of each document (u32) | control | data

and ranks.bin beside the files lists the ids by rank (u32). Files are written under a temporary name and renamed, so
a task that runs again leaves the same file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from twinsift.llm import tokens
from twinsift.llm._util import drop_scratch, get_file, id_and_text, put_file, scratch, sliced, small_batches

MAGIC = b"TWSIDS01"
_LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], 1).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative ranks below 2**32."""
    r = ranks.astype("<u4")
    n = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    code = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    code[: len(r)] = n - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks that encode_ranks() wrote."""
    lens = _LENGTHS[control].ravel()[:n].astype(np.int64)
    at = np.cumsum(lens) - lens
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lens > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_file(doc_ids: list, lens: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    head = np.array([len(doc_ids), len(ranks), len(data)], "<u8").tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), lens.astype("<u4").tobytes(), control, data])


def unpack_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    if raw[:8] != MAGIC:
        raise ValueError("not a token-id file")
    n, m, k = map(int, np.frombuffer(raw, "<u8", 3, 8))
    at = 32
    ids, at = np.frombuffer(raw, "<i8", n, at).tolist(), at + 8 * n
    nulls, at = np.frombuffer(raw, np.uint8, n, at), at + n
    lens, at = np.frombuffer(raw, "<u4", n, at), at + 4 * n
    c = -(-m // 4)
    control, data = np.frombuffer(raw, np.uint8, c, at), np.frombuffer(raw, np.uint8, k, at + c)
    return [None if x else i for i, x in zip(ids, nulls, strict=True)], lens, decode_ranks(control, data, m)


@small_batches
def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", spaced: bool = False, file_ids: int = 4_000_000) -> DataFrame:
    """Tokenises every text, ranks ids by corpus count and writes files in ascending id order; returns the manifest.

    Manifest columns: part, chunk (in order), uri, docs, ids. Null ids come first, equal ids next to each other; a null
    or empty text is the end id alone; an empty table makes no file. A file ends with the document that takes it to
    `file_ids` ids.
    """
    spark = docs.sparkSession
    spool = f"{folder}/spool"

    def tokenise(batches):
        enc = tokens.encoder(tokenizer_path, spaced)
        counts = np.zeros(0, np.int64)
        for b in sliced(batches, rows=2000, size=8 << 20):
            ids, ends = enc.encode(b.column(1))
            seen = np.bincount(ids, minlength=len(counts))
            seen[: len(counts)] += counts
            counts = seen
            wide = ids.astype("<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
            size = wide.itemsize
            offsets = pa.array(ends * size, pa.int32())
            blobs = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets.buffers()[1], pa.py_buffer(wide)])
            yield pa.RecordBatch.from_arrays([b.column(0), blobs, pa.array([size] * b.num_rows, pa.int32())], names=["doc_id", "ids", "size"])
        if counts.any():  # one more row holds this task's counts
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary()), pa.array([0], pa.int32())], names=["doc_id", "ids", "size"])

    id_and_text(docs, id_col, text_col).mapInArrow(tokenise, "doc_id long, ids binary, size int").write.option("compression", "zstd").parquet(spool)
    table = spark.read.schema("doc_id long, ids binary, size int").parquet(spool)

    def count_rows(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                x = np.frombuffer(raw, "<i8")
                if len(x) > len(total):
                    total = np.concatenate([total, np.zeros(len(x) - len(total), np.int64)])
                total[: len(x)] += x
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], names=["id", "n"])

    counted = table.filter("size = 0").select("ids").mapInArrow(count_rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = [r["id"] for r in counted.orderBy(F.desc("n"), "id").select("id").collect()]  # at most the tokenizer's vocabulary
    by_rank = np.array(order, "<u4")
    put_file(folder, "ranks.bin", by_rank.tobytes())
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank_of)

    def write(batches):
        part, chunk = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            raw = pack_file(keys, np.array([len(x) for x in held]), shared.value[np.concatenate(held)])
            uri = put_file(folder, f"part-{part:06d}-{chunk:06d}.ids", raw)
            return pa.RecordBatch.from_pylist([{"part": part, "chunk": chunk, "uri": uri, "docs": len(keys), "ids": size}])

        for b in batches:
            for key, raw, width in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                keys.append(key)
                held.append(np.frombuffer(raw, f"<u{width}"))
                size += len(held[-1])
                if size >= file_ids:
                    yield close()
                    keys, held, size, chunk = [], [], 0, chunk + 1
        if keys:
            yield close()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = table.filter("size > 0").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(write, "part long, chunk long, uri string, docs long, ids long").write.parquet(manifest)
    drop_scratch(spark, spool)
    return spark.read.schema("part long, chunk long, uri string, docs long, ids long").parquet(manifest)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Decodes the files: one row for each document with start, n_tokens and the ids as little-endian u32 bytes."""

    def decode(batches):
        by_rank = np.frombuffer(get_file(f"{folder}/ranks.bin"), "<u4")
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, lens, ranks = unpack_file(get_file(uri))
                ids = by_rank[ranks]
                after = np.cumsum(lens.astype(np.int64))
                for lo in range(0, len(keys), 1000):
                    hi = min(lo + 1000, len(keys))
                    first = int(after[lo - 1]) if lo else 0
                    cut = [ids[e - n : e].tobytes() for e, n in zip(after[lo:hi].tolist(), lens[lo:hi].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], pa.int64()), pa.array(base + first + np.concatenate([[0], np.cumsum(lens[lo:hi].astype(np.int64))[:-1]]), pa.int64()), pa.array(lens[lo:hi].astype(np.int64), pa.int64()), pa.array(cut, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    # one row a file: the running sum is over files of millions of ids, not over documents
    placed = manifest.withColumn("base", F.sum("ids").over(W.orderBy("part", "chunk")) - F.col("ids")).select("uri", "base")
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(n, "uri").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def token_digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def new_folder(spark: SparkSession) -> str:
    return scratch(spark, "token-files")
