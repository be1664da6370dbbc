"""Token-id files: raw id payloads, and a minimal perfect hash from document keys to their place.

A shard is two files. ``ids-NAME.bin``: the ids of its documents, unsigned little-endian, in 16 bits where the vocabulary has
at most 65,536 ids and else in 32, one document after the other in ascending order of doc_id. ``ids-NAME.npz``: the keys in that order, the perfect hash with fingerprints, and by
hash place the start in the payload and the count. A key is (doc_id, how many rows with this id came before); so once the index
of a shard is loaded, a lookup costs one hash walk and one ranged read, whatever the number of documents. ``manifest`` lists the shards,
their names, first keys and the ids before them. A name has the attempt of the task in it, and the manifest has that of the
attempt that Spark committed: both files of a shard count at once, and what another attempt left is never read.

Defined results: a null or empty text is the end id alone; null ids come first; repeated rows are kept, ordered by their
text; further columns are ignored; an empty table gives a manifest without shards.
"""

from __future__ import annotations

import bisect
import io
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.sources.shared import qualified, shared_dir

from .common import table, written
from .perfect_hash import PerfectHash
from .tokens import END_ID, VOCABULARY, encoder

_NULL = np.uint64(1 << 63)
_MANIFEST = "shard long, name string, n_docs long, n_ids long, first_id long, first_null boolean"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _kind(n_ids: int) -> str:
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def _parts(ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(nulls, 0, ids).astype(np.int64).view(np.uint64), nth.astype(np.uint64) | np.where(nulls, _NULL, np.uint64(0))


def write_tokens(docs: DataFrame, uri: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes the shards below ``uri`` and returns the manifest, with ``base``: the ids in all shards before.

    A path without a scheme is on the file system that Spark uses.
    """
    uri = qualified(docs.sparkSession, uri)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, (fs, root) = task.partitionId(), _fs(uri)
        fs.create_dir(root, recursive=True)
        name = f"{shard:05d}-{task.taskAttemptId()}"
        own = f"{root}/ids-{name}"
        enc = encoder(vocabulary)
        kind = _kind(enc.n_ids)
        end = np.array([END_ID], kind).tobytes()
        keys: list[int | None] = []
        counts: list[int] = []
        with fs.open_output_stream(f"{own}.bin") as out:
            for b in batches:
                for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode_column(b.column(1)), strict=True):
                    out.write(np.frombuffer(ids, "<u4").astype(kind).tobytes() + end)
                    keys.append(doc_id)
                    counts.append(len(ids) // 4 + 1)
        if not keys:
            fs.delete_file(f"{own}.bin")
            return
        nulls = np.array([k is None for k in keys])
        ids, n = np.array([k or 0 for k in keys], np.int64), np.array(counts, np.int64)
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])]))
        nth = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        mph = PerfectHash.build(*_parts(ids, nulls, nth))
        place = mph.find(*_parts(ids, nulls, nth))
        start, count = np.empty(len(n), "<i8"), np.empty(len(n), "<i8")
        start[place], count[place] = np.cumsum(n) - n, n
        buffer = io.BytesIO()
        np.savez(buffer, kind=np.array(kind), ids=ids, nulls=nulls, nth=nth, start=start, count=count, **mph.arrays())
        with fs.open_output_stream(f"{own}.npz") as out:
            out.write(buffer.getvalue())
        row = [[shard], [name], [len(n)], [int(n.sum())], [int(ids[0])], [bool(nulls[0])]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int64(), pa.string(), *[pa.int64()] * 3, pa.bool_()], strict=True)], names=["shard", "name", "n_docs", "n_ids", "first_id", "first_null"])

    # The second and third keys only part rows with one id, so that no id (null, say) has to fit one shard.
    by = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("text")]
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(*by[:2]).sortWithinPartitions(*by).select("doc_id", "text")
    shards = written(dealt.mapInArrow(run, _MANIFEST), "manifest")
    # As many rows as shards, so one task can add them up.
    rows = sorted(shards.collect())
    base, out = 0, []
    for r in rows:
        out.append((*r, base))
        base += r.n_ids
    return docs.sparkSession.createDataFrame(out, _MANIFEST + ", base long")


class Shard:
    def __init__(self, uri: str, name: str):
        self.fs, root = _fs(uri)
        self.payload = f"{root}/ids-{name}.bin"
        with self.fs.open_input_file(f"{root}/ids-{name}.npz") as f:
            self.index = dict(np.load(io.BytesIO(f.read())))
        self.kind = np.dtype(str(self.index["kind"]))
        self.hash = PerfectHash.of({k: v for k, v in self.index.items() if k == "marks" or k.startswith(("bits", "before"))})

    def find(self, ids: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and count of each key; -1 and 0 where it has none."""
        place = self.hash.find(*_parts(ids, nulls, nth))
        return np.where(place < 0, -1, self.index["start"][place]), np.where(place < 0, 0, self.index["count"][place])

    def read(self, payload: pa.NativeFile, start: int, count: int) -> np.ndarray:
        payload.seek(start * self.kind.itemsize)
        return np.frombuffer(payload.read(count * self.kind.itemsize), self.kind).astype("<u4")


class TokenReader:
    """Keyed access for one process: constant time a key, and only the shards that are asked for are opened; the last ``most`` stay open.

    ``uri`` has a scheme, or is a local path.
    """

    def __init__(self, uri: str, manifest: list, most: int = 16):
        self.uri, self.most, self.rows = uri, most, sorted(manifest, key=lambda r: r.shard)
        self.firsts = [(not r.first_null, 0 if r.first_null else r.first_id) for r in self.rows]
        self.open: OrderedDict[str, Shard] = OrderedDict()

    def _shard(self, name: str) -> Shard:
        s = self.open.pop(name, None) or Shard(self.uri, name)
        self.open[name] = s
        if len(self.open) > self.most:
            self.open.popitem(last=False)
        return s

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of the first row with this key (``nth``: of a later one in the same shard), or None."""
        key = (doc_id is not None, doc_id or 0)
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key)):
            s = self._shard(self.rows[k].name)
            start, count = s.find(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([nth]))
            if start[0] >= 0:
                with s.fs.open_input_file(s.payload) as f:
                    return s.read(f, int(start[0]), int(count[0]))
        return None


def read_tokens(manifest: DataFrame, uri: str) -> DataFrame:
    """Per document, from the files: doc_id, start (over all shards), n_tokens, ids_crc32. One task a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), strict=True):
                s = Shard(uri, name)
                ids, nulls = s.index["ids"], s.index["nulls"]
                start, count = s.find(ids, nulls, s.index["nth"])
                with s.fs.open_input_file(s.payload) as f:
                    for lo in range(0, len(ids), 1024):
                        crc = []
                        for at, n in zip(start[lo : lo + 1024].tolist(), count[lo : lo + 1024].tolist(), strict=True):
                            crc.append(zlib.crc32(s.read(f, at, n).tobytes()))
                        part = slice(lo, lo + 1024)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[part], pa.int64(), mask=nulls[part]), pa.array(start[part] + base), pa.array(count[part]), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    uri = qualified(manifest.sparkSession, uri)
    n = max(1, manifest.count())
    dealt = manifest.select("name", "base").repartition(n, "name")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), uri), uri)
