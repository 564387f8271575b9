"""Training-order materialisation: token sequences at keyed-random global slots in fixed-stride binary shards.

1. ``sequences``: documents are tokenised (byte-level BPE from a public vocabulary file) and packed: within a task
   the documents follow each other, each ended by the end-of-text id, and are cut into sequences of ``length``
   ids; the task's last sequence is padded. The sequences are stored once, compressed, with their task and place.
2. ``slots``: sequence number = sequences of earlier tasks + place. A four-round keyed Feistel network permutes
   the next power of four at or above their count; cycle walking repeats it until the result is a slot below the
   count. So every sequence gets a slot of its own and no table of the permutation is needed.
3. ``write_shards``: slots are dealt by shard (``per_shard`` consecutive slots), sorted, and written by Spark's text
   writer as one file a shard, so commits, retries and remote stores are Spark's. A record has a fixed stride:
   little-endian uint16 ids, a uint16 count of ids in use, and a line feed. Slot s is record s % per_shard of shard
   s // per_shard, so a reader resumes at any slot by seeking.

The vocabulary must have fewer than 65,535 ids. Cases: null or empty text gives the end-of-text id alone; a null doc_id
is kept; an empty table gives no sequences and an empty manifest; other columns are ignored; repeated rows are rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.common import stored, tidy
from tarmac.session import scratch_path

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published split pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048  # ids in a sequence
PER_SHARD = 4096  # sequences in a shard: 16 MB
KEY = "training-order"
ROUNDS = 4
CACHE = 400_000  # pieces remembered by a worker
SCHEMA = "task int, place long, n_ids int, doc_ids array<long>, ids binary"

_workers: dict[str, tuple] = {}


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokenizer:
    """BPE with a memory of the pieces between spaces.

    No token spans a space that a non-space follows, so a text can be encoded as its parts split before each such
    space; parts repeat, and most are looked up.
    """

    def __init__(self, path: str):
        import tiktoken

        ranks = vocabulary(path)
        self.end = max(ranks.values()) + 1
        if self.end >= 65535:
            raise ValueError("the vocabulary must fit 16 bits")
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) \
            .encode_ordinary
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if not piece or piece[0].isspace():
            raise ValueError("white space after a space")
        if len(self.known) >= CACHE:
            self.known.clear()
        out = self.known[piece] = np.array(self.encode(" " + piece), "<u2").tobytes()
        return out

    def ids(self, text: str) -> bytes:
        """The ids of the text as little-endian uint16."""
        first, *parts = text.split(" ")
        known, piece = self.known.get, self._piece
        try:
            return np.array(self.encode(first), "<u2").tobytes() + b"".join([known(p) or piece(p) for p in parts])
        except ValueError:  # runs of white space: such a text is encoded as one
            return np.array(self.encode(text), "<u2").tobytes()


def _tokenizer(path: str) -> Tokenizer:
    if path not in _workers:
        _workers[path] = Tokenizer(path)
    return _workers[path]


def sequences(documents: DataFrame, length: int = LENGTH, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(task, place, n_ids, doc_ids, ids): packed sequences, ids zstd-compressed uint16 padded to ``length``."""
    def run(batches):
        from pyspark import TaskContext

        task, place = TaskContext.get().partitionId(), 0
        tok = _tokenizer(vocabulary_path)
        end = np.array([tok.end], "<u2").tobytes()
        press = zstandard.ZstdCompressor(level=6).compress
        size = 2 * length
        held, owners = bytearray(), []  # owners: (offset in held where a document begins, doc_id)

        def flush(last):
            nonlocal held, owners, place
            rows, at, o = [], 0, 0
            while len(held) - at >= size or last and at < len(held):
                cut = bytes(held[at:at + size])
                while o + 1 < len(owners) and owners[o + 1][0] <= at:
                    o += 1
                e = o
                while e + 1 < len(owners) and owners[e + 1][0] < at + len(cut):
                    e += 1
                ids = [d for _, d in owners[o:e + 1]]
                rows.append((task, place, len(cut) // 2, ids, press(cut.ljust(size, b"\xff"))))
                place += 1
                at += size
            while o + 1 < len(owners) and owners[o + 1][0] <= at:
                o += 1
            owners = [(p - at, d) for p, d in owners[o:]] if at < len(held) else []
            held = held[at:]
            return rows

        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                owners.append((len(held), doc))
                held += tok.ids(text) + end
                if len(held) > 1 << 20:
                    rows += flush(False)
            yield _batch(rows + flush(False))
        yield _batch(flush(True))

    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(tidy(run), SCHEMA)


def _batch(rows):
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=["task", "place", "n_ids", "doc_ids", "ids"])


def feistel(number, count: int, key: str = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Keyed permutation of [0, count): balanced Feistel network on 2k bits with cycle walking."""
    half = max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}|{r}".encode(), digest_size=8).digest(), "little"))
            for r in range(rounds)]
    shift = np.uint64(half)

    def mixed(x, k):  # 64-bit finaliser of the half and the round's key
        x = x ^ k
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    out = np.asarray(number, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right, k) & mask)
        x = left << shift | right
        out[todo] = x
        todo = todo[x >= np.uint64(count)]
    return out.astype(np.int64)


def slots(seqs: DataFrame, key: str = KEY, per_shard: int = PER_SHARD) -> DataFrame:
    """``seqs`` plus number, slot and shard. ``seqs`` must be stored: it is read twice."""
    sizes = seqs.groupBy("task").agg(F.count("*").alias("n"))
    count = sizes.agg(F.sum("n")).first()[0] or 0
    earlier = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("long")
    def slot(number):
        import pandas as pd
        return pd.Series(feistel(number.to_numpy(), count, key))

    # One row per task of the packing pass: some bytes for each input split.
    return (seqs.join(F.broadcast(base), "task").withColumn("number", F.col("before") + F.col("place")).drop("before")
            .withColumn("slot", slot("number")).withColumn("shard", F.floor(F.col("slot") / per_shard)))


def stride(length: int = LENGTH) -> int:
    return 2 * length + 3


def write_shards(documents: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD,
                 key: str = KEY, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Write the shards under ``path`` (shard=<k>/part-*) and return the manifest, one row per sequence.

    Manifest: slot, shard, byte_offset in the shard's file, number, n_ids, doc_ids (in order), crc (of the record).
    """
    spark = documents.sparkSession
    placed = slots(stored(sequences(documents, length, vocabulary_path), "sequences"), key, per_shard)
    # A sequence of the shard's number keeps a shard together; the number of shards follows the data.
    dealt = placed.repartition("shard")

    def records(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = [expand(x, max_output_size=2 * length) + n.to_bytes(2, "little")
                    for x, n in zip(b.column("ids").to_pylist(), b.column("n_ids").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("slot"), pa.array(rows, pa.binary())],
                                             names=["shard", "slot", "record"])

    bins = dealt.select("shard", "slot", "n_ids", "ids").mapInArrow(tidy(records), "shard long, slot long, record binary")
    # Sorted after the Python step, whose output has no known order: the writer then adds no sort by shard alone.
    bins.sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").text(path)
    manifest = placed.select("slot", "shard", (F.col("slot") % per_shard * stride(length)).alias("byte_offset"),
                             "number", "n_ids", "doc_ids", "ids")

    def sums(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            crc = [zlib.crc32(expand(x, max_output_size=2 * length) + n.to_bytes(2, "little"))
                   for x, n in zip(b.column("ids").to_pylist(), b.column("n_ids").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())],
                                             names=[*b.schema.names[:-1], "crc"])

    return manifest.mapInArrow(tidy(sums), "slot long, shard long, byte_offset long, number long, n_ids int, "
                                     "doc_ids array<long>, crc long")


def read_shards(spark: SparkSession, path: str, first_slot: int = 0, length: int = LENGTH,
                per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, n_ids, ids array<int>) of all slots from ``first_slot`` on, whole shards before it not being read."""
    step = stride(length)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
             .select(F.col("shard").cast("long").alias("shard"), "content")
             .filter(F.col("shard") >= first_slot // per_shard))

    def run(batches):
        for b in batches:
            for shard, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rec = np.frombuffer(body, np.uint8).reshape(-1, step)
                at = np.arange(len(rec)) + shard * per_shard
                rec = rec[at >= first_slot]
                n = rec[:, 2 * length:2 * length + 2].copy().view("<u2")[:, 0].astype(np.int32)
                ids = rec[:, :2 * length].copy().view("<u2")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[at >= first_slot]), pa.array(n),
                     pa.array([r[:k].astype(np.int32) for r, k in zip(ids, n)], pa.list_(pa.int32()))],
                    names=["slot", "n_ids", "ids"])

    return files.mapInArrow(run, "slot long, n_ids int, ids array<int>")


def materialise(documents: DataFrame, **options) -> DataFrame:
    """``write_shards`` into a new folder of the shared scratch space."""
    return write_shards(documents, scratch_path(documents.sparkSession, "shards"), **options)
