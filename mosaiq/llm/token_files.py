"""Token ids as flat files of unsigned integers, with 64-bit document offsets.

Part i has part-i.bin (ids, uint16 or uint32, little-endian), part-i.idx (int64: the
place of each document's first id in the part, and the end) and part-i.ids (int64:
document ids). Parts ascend by document id; a part's place in the whole is the sum of
the ids before it, from the manifest.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.shared import back, keyed, prefix_sums, scratch, staged
from mosaiq.llm.tokens import crc, encoder


def _local(path: str) -> str | None:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith(("/", "file:")) else None


class _Part:
    """Files that appear under their names only when whole; a task that runs again writes the same bytes."""

    KINDS = ("bin", "idx", "ids")

    def __init__(self, folder: str, i: int):
        self.local = _local(folder)
        if self.local is None:
            from pyarrow import fs

            self.fs, folder = fs.FileSystem.from_uri(folder)
        self.names = {k: f"{self.local or folder}/part-{i:07d}.{k}" for k in self.KINDS}
        self.temp = {k: f"{n}.{uuid.uuid4().hex}" for k, n in self.names.items()}
        self.out = {k: open(t, "wb") if self.local else self.fs.open_output_stream(t) for k, t in self.temp.items()}

    def write(self, kind: str, data: bytes) -> None:
        self.out[kind].write(data)

    def done(self) -> None:
        for k in self.KINDS:
            self.out[k].close()
            if self.local:
                os.replace(self.temp[k], self.names[k])
                continue
            try:
                self.fs.move(self.temp[k], self.names[k])
            except OSError:  # some stores don't move onto a name that an earlier attempt left; its bytes are the same
                from pyarrow import fs

                if self.fs.get_file_info(self.names[k]).type == fs.FileType.NotFound:
                    raise
                self.fs.delete_file(self.temp[k])


class _Ranged:
    """A file in a store, read by ranges of items as a mapped one is."""

    def __init__(self, file, dtype):
        self.file, self.dtype = file, np.dtype(dtype)

    def __getitem__(self, part: slice) -> np.ndarray:
        start = 0 if part.start is None else int(part.start)
        stop = self.file.size() // self.dtype.itemsize if part.stop is None else int(part.stop)
        return np.frombuffer(self.file.read_at((stop - start) * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)


def _mapped(folder: str, i: int, kind: str, dtype) -> np.ndarray | _Ranged:
    if (local := _local(folder)) is not None:
        name = f"{local}/part-{i:07d}.{kind}"
        return np.memmap(name, dtype, "r") if os.path.getsize(name) else np.zeros(0, dtype)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    return _Ranged(store.open_input_file(f"{at}/part-{i:07d}.{kind}"), dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, *, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts into files below folder; the manifest: part, n_docs, n_tokens, width, base.

    Documents ascend by id (null last, ties by text). Null and empty texts have the end
    id alone. folder is in a store that the executors share. An empty table: no parts.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    n = parts or max(1, docs.select(id_col).rdd.getNumPartitions())
    if (local := _local(folder)) is not None:
        os.makedirs(local, exist_ok=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, i = encoder(tokenizer), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        part, n_docs, at = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = _Part(folder, i)
                part.write("idx", np.zeros(1, "<i8").tobytes())
            part.write("ids", batch.column("id").to_numpy().astype("<i8").tobytes())
            ends = []
            for ids in enc.encode(batch.column("text").to_pylist()):
                part.write("bin", ids + end)
                at += (len(ids) + len(end)) // enc.dtype.itemsize
                ends.append(at)
            part.write("idx", np.array(ends, "<i8").tobytes())
            n_docs += batch.num_rows
        if part is not None:
            part.done()
            yield pa.RecordBatch.from_pydict({"part": [i], "n_docs": [n_docs], "n_tokens": [at], "width": [enc.dtype.itemsize]}, schema=pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    # the texts' beginnings too, or rows of one id (or none) would all meet in one part
    ordered = rows.repartitionByRange(n, F.col("id"), F.substring("text", 1, 64)).sortWithinPartitions("id", "text")
    done = staged(ordered.mapInArrow(encode, "part long, n_docs long, n_tokens long, width int"), "manifest")
    return prefix_sums(done, "part", "n_tokens")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids before it in all parts), n_tokens, ids (binary, `width` bytes each), width, ids_crc32 (as 32-bit ids): from the mapped files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dtype = np.dtype(f"<u{row['width']}")
                data, idx, ids = _mapped(folder, row["part"], "bin", dtype), _mapped(folder, row["part"], "idx", "<i8")[:], _mapped(folder, row["part"], "ids", "<i8")[:]
                a = 0
                while a < len(ids):  # by some MB at a time
                    b = max(a + 1, int(np.searchsorted(idx, idx[a] + (1 << 21), "right")) - 1)
                    some = data[idx[a] : idx[b]]
                    each = [some[x:y].tobytes() for x, y in zip(idx[a:b] - idx[a], idx[a + 1 : b + 1] - idx[a], strict=True)]
                    cols = [ids[a:b], idx[a:b] + row["base"], np.diff(idx[a : b + 1]), pa.array(each, pa.binary()), np.full(b - a, row["width"], np.int32), pa.array([crc(x, dtype) for x in each], pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "start", "n_tokens", "ids", "width", "ids_crc32"])
                    a = b

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = manifest.select("part", "base", "width").repartition(n, "part")  # a number, or so few rows would meet in one task
    rows = spread.mapInArrow(read, "id long, start long, n_tokens long, ids binary, width int, ids_crc32 long")
    return rows.select(back(F.col("id")).alias("doc_id"), "start", "n_tokens", "ids", "width", "ids_crc32")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch(spark, "tokens")
    manifest = write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), 2)

    return read_token_files(manifest, folder).drop("ids", "width")
