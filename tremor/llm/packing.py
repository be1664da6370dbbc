"""Best-fit packing by the sum-of-squares rule.

Documents become token ids once; only (document, piece, length) rows go on. They are dealt out at random, each task packs
its share, and a second round packs what the first left open: a sequence that still has room is an item of that round.
A task takes items in falling order of length and puts each where the sum over residual gaps of the squared number of
open sequences grows least; a new sequence is opened only where nothing fits. Memory of a task: one counter a gap, and
16 bytes an item of its share (``share`` items).

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they come (their pieces
are alike in all columns but the place); further columns are ignored; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .tokens import END_ID, ROOM, VOCABULARY, encoder

CAPACITY = 2048
SHARE = 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False, room: int = ROOM) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, on demand, ids. The first piece is the short one.

    ``room``: pieces of texts that a task remembers, which costs memory and saves time.
    """
    schema = _PIECES + (", ids array<long>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, room), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_column(b.column(1)), strict=True):
                raw = ids + end
                n = len(raw) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = raw[4 * lo : 4 * hi]
                    row = (doc_id, k, lo, hi - lo, zlib.crc32(part), np.frombuffer(part, "<u4").tolist() if keep_ids else None)
                    for column, v in zip(out, row, strict=False):
                        column.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names[: len(out)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items in the given order: the sequence of each, its offset there, and how full each sequence is."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # by residual gap
    n = np.zeros(capacity + 1, np.int64)
    place, offset, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            place[i], offset[i] = len(fill), 0
            fill.append(s)
            continue
        have = n[s:]
        # moving a sequence from gap g to g - s changes the sum by 2 (N[g-s] - N[g]) + 2; closing one by 1 - 2 N[s]
        grows = 2 * (n[: capacity + 1 - s] - have) + 2
        grows[0] = 1 - 2 * n[s]
        k = int(np.where(have > 0, grows, never).argmin())
        if have[k] == 0:
            b = len(fill)
            fill.append(0)
            left = capacity - s
        else:
            b = open_at[s + k].pop()
            n[s + k] -= 1
            left = k
        place[i], offset[i] = b, fill[b]
        fill[b] += s
        if left:
            open_at[left].append(b)
            n[left] += 1
    return place, offset, np.array(fill, np.int64)


def _round(items: DataFrame, keys: list[str], capacity: int, share: int, tag: int) -> DataFrame:
    """``items`` with length, dealt to tasks and packed there: adds bin (tag and task in its high bits) and at."""
    n = items.count()
    tasks = max(1, -(-n // share))
    schema = items.select(*keys, "length")
    names = schema.columns

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = pa.Table.from_batches(list(frames), None) if (frames := list(frames)) else None
        if t is None or not t.num_rows:
            return
        place, at, _ = sum_of_squares(t.column("length").to_numpy(), capacity)
        base = (tag << 62) | (TaskContext.get().partitionId() << 32)
        t = t.append_column("bin", pa.array(place + base, pa.int64())).append_column("at", pa.array(at, pa.int64()))
        yield from t.to_batches()

    dealt = schema.repartition(tasks, F.xxhash64(*keys)).sortWithinPartitions(F.desc("length"), *keys)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.schema)
    assert names[-1] == "length"
    return written(dealt.mapInArrow(run, f"{types}, bin long, at long"), "packing-round")


def pack(pieces: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of at most ``capacity``."""
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    first = _round(pieces, ["_row"], capacity, share, 0)
    bins = first.groupBy("bin").agg(F.sum("length").alias("length"))
    open_bins = bins.filter(F.col("length") < capacity).select(F.col("bin").alias("b1"), "length")
    second = _round(open_bins, ["b1"], capacity, share, 1).select(F.col("b1"), F.col("bin").alias("b2"), F.col("at").alias("base"))
    placed = first.join(second, first.bin == second.b1, "left").select(
        "_row", F.coalesce("b2", "bin").alias("sequence_id"), (F.coalesce("base", F.lit(0)) + F.col("at")).alias("offset")
    )
    return pieces.join(placed, "_row").drop("_row")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(token_pieces(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
