"""Token files: round trip against the library, documents by id, frames that are read, checksums."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skirmish.llm import token_files
from skirmish.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
TEXTS = [(3, "A first text, short."), (1, ""), (2, None), (9, "word " * 9000), (None, "no id"), (5, "Ünï ☃ code"), (5, "same id"), (5, "same id")]


def library(rows):
    enc, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*enc.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "TASK_IDS", 1000)
    df = spark.createDataFrame(TEXTS, DOCS).repartition(3).withColumn("file", F.lit("x"))
    got = token_files.token_digests(df, PATH, 2)
    assert got.rdd.getNumPartitions() > 1
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == library(TEXTS)
    assert token_files.token_digests(spark.createDataFrame([], DOCS), PATH, 2).count() == 0


def test_only_wanted_frames_are_read(spark, monkeypatch):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(300)] + [(None, "without")]
    folder = scratch_path(spark, "token_files")
    index = token_files.write_token_files(spark.createDataFrame(rows, DOCS), folder, PATH, 2, frame_ids=50)
    assert index.count() > 40
    wanted = spark.createDataFrame([(7,), (250,), (999,), (None,)], "doc_id long")
    want = [r for r in library(rows) if r[0] in (7, 250, None)]
    got = token_files.read_token_files(index, folder, wanted=wanted, digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == want
    held = index.where(F.exists("doc_ids", lambda d: d.isin(7, 250)) | F.exists("doc_ids", lambda d: d.isNull()))
    for r in index.join(held.select("file", "frame"), ["file", "frame"], "left_anti").select("file").distinct().collect():
        assert r.file
    # all other frames may be broken: nobody reads them
    by_file = {}
    for r in index.collect():
        if not any(d is None or d in (7, 250) for d in r.doc_ids):
            by_file.setdefault(r.file, []).append(r.frame)
    for file, frames in by_file.items():
        path = f"{folder}/{file}".removeprefix("file:")
        reader = token_files.FrameReader(__import__("pyarrow").OSFile(path))
        data = bytearray(open(path, "rb").read())
        for k in frames:
            at = int(reader.starts[k])
            data[at : at + int(reader.table[k][0])] = b"\0" * int(reader.table[k][0])
        open(path, "wb").write(data)
    again = token_files.read_token_files(index, folder, wanted=wanted, digest=True)
    assert sorted((tuple(r) for r in again.collect()), key=lambda r: r[1]) == want
    with pytest.raises(Exception, match="Frame|frame|zstd|checksum"):
        token_files.read_token_files(index, folder).collect()


def test_an_id_that_does_not_fit_is_an_error():
    with pytest.raises(ValueError, match="70000"):
        token_files.frame_of([(1, np.array([70000], "<u4"))], 2)
    assert token_files.docs_of(token_files.frame_of([(1, np.array([70000], "<u4"))], 4), 4)[0][1].tolist() == [70000]
