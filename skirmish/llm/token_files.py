"""Token ids in files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A file is a row of frames in the public seekable format: ordinary frames, then one skippable frame that holds the
compressed size, the plain size and the low 32 bits of the XXH64 (seed 0) of the plain bytes of each frame, and a
nine-byte footer. A frame holds one document of at least ``FRAME_IDS`` ids, or neighbours of fewer ids together:
``number of documents (u32), doc ids (i64 each), numbers of ids (u32 each), ids (u16 or u32 each)``, all little-endian.
A reader takes the footer, the table, and then only the frames that it asks for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.llm.bpe import encoder
from skirmish.llm.common import whole_text
from skirmish.session import scratch_path, stage

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed by the format
CHECKSUMS = 0x80
FRAME_IDS = 4096
TASK_IDS = 8_000_000  # ids that a reading task takes, about
NO_ID = -(2**63)  # stands for a null doc_id inside a frame


def open_folder(uri: str):
    """A file system and a path for any address that pyarrow knows (file, hdfs, s3, ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def frame_of(docs: list[tuple[int, np.ndarray]], width: int) -> bytes:
    most = max((int(i.max()) for _, i in docs if len(i)), default=0)
    if most >> 8 * width:
        raise ValueError(f"token id {most} doesn't fit {width} bytes")
    head = struct.pack("<I", len(docs)) + np.array([d for d, _ in docs], "<i8").tobytes() + np.array([len(i) for _, i in docs], "<u4").tobytes()
    return head + b"".join(i.astype(f"<u{width}").tobytes() for _, i in docs)


def docs_of(plain: bytes, width: int) -> list[tuple[int, np.ndarray]]:
    (n,) = struct.unpack_from("<I", plain)
    ids, counts = np.frombuffer(plain, "<i8", n, 4), np.frombuffer(plain, "<u4", n, 4 + 8 * n)
    held = np.frombuffer(plain, f"<u{width}", offset=4 + 12 * n)
    return list(zip(ids.tolist(), np.split(held.astype("<u4"), np.cumsum(counts)[:-1])))


class FrameWriter:
    """Writes frames to ``sink`` one at a time; what it holds is one frame and twelve bytes for each written one."""

    def __init__(self, sink, level: int = 3):
        import xxhash
        import zstandard

        self.sink, self.table, self.at = sink, [], 0
        self.pack, self.hash = zstandard.ZstdCompressor(level=level, write_checksum=True).compress, xxhash.xxh64_intdigest

    def add(self, plain: bytes) -> int:
        packed = self.pack(plain)
        self.sink.write(packed)
        self.table.append((len(packed), len(plain), self.hash(plain) & 0xFFFFFFFF))
        self.at += len(packed)
        return len(self.table) - 1

    def finish(self) -> None:
        body = b"".join(struct.pack("<III", *e) for e in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Reads single frames of a seekable source."""

    def __init__(self, source):
        import xxhash
        import zstandard

        self.source, self.unpack, self.hash = source, zstandard.ZstdDecompressor().decompress, xxhash.xxh64_intdigest
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        body = self._read(size - 9 - 12 * frames, 12 * frames)
        self.table = np.frombuffer(body, "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        packed, plain, check = (int(x) for x in self.table[k])
        got = self.unpack(self._read(int(self.starts[k]), packed), max_output_size=plain)
        if len(got) != plain or self.hash(got) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return got


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, width: int = 2, frame_ids: int = FRAME_IDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order; returns the index ``file_no, file, frame, docs, ids,
    doc_ids`` (``doc_ids``: the documents of the frame, so that a reader finds the frames of those it wants).

    One range partition, one file; the files' order is the order of ids. A task that runs twice writes twice, under
    names of its own, and the index names the copy whose task was committed. Null text: the end id alone. Null ids come
    first and are read back as null. Repeated rows are all kept, and a hot id is split over files. An empty table
    gives an empty index. ``width``: bytes of an id, 2 up to 65,536 ids; an id that doesn't fit is an error.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        sink, held, size, rows, name = None, [], 0, [], f"tokens-{part:06d}-{uuid.uuid4().hex}.zst"
        system, where = open_folder(folder)

        def close() -> None:
            rows.append((part, name, writer.add(frame_of(held, width)), len(held), size, [None if d == NO_ID else d for d, _ in held]))

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                if sink is None:
                    system.create_dir(where, recursive=True)
                    sink = system.open_output_stream(f"{where}/{name}", compression=None)
                    writer = FrameWriter(sink)
                ids = np.append(enc.ids(text), np.uint32(end_id))
                if held and size + len(ids) > frame_ids:
                    close()
                    held, size = [], 0
                held.append((NO_ID if pd.isna(doc) else int(doc), ids))
                size += len(ids)
        if sink is not None:
            close()
            writer.finish()
            sink.close()
        yield pd.DataFrame(rows, columns=["file_no", "file", "frame", "docs", "ids", "doc_ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return stage(ordered.mapInPandas(write, "file_no int, file string, frame int, docs long, ids long, doc_ids array<long>"), "token_index")


def read_token_files(index: DataFrame, folder: str, width: int = 2, wanted: DataFrame | None = None, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids`` (``digest``: ``ids_crc32``, taken where the frame is unpacked) of all documents,
    or of those in ``wanted`` (``doc_id``): then only their frames are read.

    ``start`` counts the ids of all documents before, over all files. Frames are dealt to tasks by their place, about
    TASK_IDS ids each, whatever the files' sizes.
    """
    sums = index.groupBy("file_no").agg(F.sum("ids").alias("in_file"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = sums.select("file_no", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("file_start"))
    in_file = Window.partitionBy("file_no").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.withColumn("ahead", F.coalesce(F.sum("ids").over(in_file), F.lit(0))).join(files, "file_no")
    placed = placed.withColumn("start", F.col("file_start") + F.col("ahead"))
    if wanted is not None:
        ids = wanted.select(F.col("doc_id").cast("long").alias("want")).distinct()
        hit = placed.select("start", F.explode("doc_ids").alias("doc_id")).join(ids, F.col("doc_id").eqNullSafe(F.col("want")))
        placed = placed.join(hit.groupBy("start").agg(F.collect_set("doc_id").alias("asked"), F.max(F.col("doc_id").isNull()).alias("nulls")), "start")
    else:
        placed = placed.withColumns({"asked": F.lit(None).cast("array<long>"), "nulls": F.lit(False)})
    every = wanted is None
    tasks = int(index.agg(F.coalesce(F.sum("ids"), F.lit(0))).first()[0]) // TASK_IDS + 1
    dealt = placed.select("file", "frame", "start", "asked", "nulls").repartitionByRange(tasks, "start").sortWithinPartitions("start")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, where = open_folder(folder)
        reader = name = None
        for batch in batches:
            for at in range(0, len(batch), 64):
                out = []
                for file, frame, start, asked, nulls in batch.iloc[at : at + 64].itertuples(index=False):
                    if file != name:
                        reader, name = FrameReader(system.open_input_file(f"{where}/{file}")), file
                    only = None if every else {*asked.tolist(), *([NO_ID] if nulls else [])}
                    for doc, ids in docs_of(reader.frame(frame), width):
                        if only is None or doc in only:
                            held = zlib.crc32(ids.tobytes()) if digest else ids.astype(np.int32)
                            out.append((None if doc == NO_ID else doc, start, len(ids), held))
                        start += len(ids)
                got = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                got["doc_id"] = got["doc_id"].astype("Int64")
                yield got

    return dealt.mapInPandas(read, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<int>'}")


def token_digests(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes token files, reads them all back and returns ``doc_id, start, n_tokens, ids_crc32`` of what was read."""
    folder = scratch_path(docs.sparkSession, "token_files")
    return read_token_files(write_token_files(docs, folder, path, end_id), folder, digest=True)
