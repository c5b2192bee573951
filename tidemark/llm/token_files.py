"""Operator 7: token ids in files of independent zstandard frames with a trailing seek table.

File format: one frame a document, each followed by the byte 0x0A. The last frame holds the seek table, packed
little-endian entries (doc_id int64, offset uint64, size uint32, n_tokens uint64, crc32 uint32, null uint32); after
it stands its own size as 16 hexadecimal digits and "TOKSEEK1", each line ended by 0x0A. Files are written by
Spark's text writer, so that its commit protocol covers them and any Hadoop store can hold them.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Packed, runs
from .common import bounded, cut, delete, read, scratch, shared_folder


ENTRY = "<qQIQII"
MAGIC = b"TOKSEEK1"
TAIL = 16 + 1 + len(MAGIC) + 1


@lru_cache(2)
def packer(path: str) -> Packed:
    """The file's tokenizer. Where it does no more than byte-level BPE with that library's own pattern, texts are encoded by chunks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path) as f:
        made = json.load(f)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    spaced = not made["normalizer"] and not made["post_processor"] and plain.items() <= (made["pre_tokenizer"] or {}).items()
    return Packed(Tokenizer.from_file(path), spaced, tuple(t["content"] for t in made["added_tokens"]), offsets=False)


def frames(path: str, end_id: int):
    """A partition's rows (doc_id, text) to the lines of one file."""

    def run(batches):
        import zstandard

        made, at, table, end = zstandard.ZstdCompressor(level=1, write_content_size=True), 0, [], struct.pack("<I", end_id)
        make = packer(path)
        for batch in batches:
            for part in runs(batch, 1):
                pending = []
                ids, ends, _ = make.arrays(part.column(1))
                ids, ends = ids.tobytes(), (4 * ends).tolist()
                for a, b, key in zip(ends, ends[1:], part.column(0).to_pylist()):
                    raw = ids[a:b] + end
                    packed = made.compress(raw)
                    table.append(struct.pack(ENTRY, key if key is not None else 0, at, len(packed), len(raw) // 4, zlib.crc32(raw), key is None))
                    at += len(packed) + 1
                    pending.append(packed)
                yield pa.RecordBatch.from_arrays([pa.array(pending, pa.binary())], ["value"])
        if table:
            seek = made.compress(b"".join(table))
            yield pa.RecordBatch.from_arrays([pa.array([seek, b"%016x" % len(seek), MAGIC], pa.binary())], ["value"])

    return run


#: A file holds the ids of about so many bytes of text.
FILE_BYTES = 32 << 20


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, files: int | None = None) -> None:
    """Write ids in ascending doc_id order over files. Null text counts as empty; null ids come first; rows of one id in no set order."""
    bounded(docs.sparkSession)
    if files is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = 1 + total // FILE_BYTES
    # ranges of (id, hash), so that rows of one frequent id spread over files
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    lines = dealt.mapInArrow(frames(tokenizer_path, end_id), "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(folder)


def seek_table(file) -> list[tuple]:
    """The entries of a file, from its end; file has size(), seek() and read(). Only the table is read."""
    import zstandard

    whole = file.size()
    if not whole:
        return []
    file.seek(max(0, whole - TAIL))
    tail = file.read(TAIL)
    if tail[-1 - len(MAGIC) : -1] != MAGIC:
        raise ValueError("not a token file: no magic at its end")
    size = int(tail[:16], 16)
    file.seek(whole - TAIL - 1 - size)
    return list(struct.iter_unpack(ENTRY, zstandard.ZstdDecompressor().decompress(file.read(size))))


def document(packed: bytes, entry: tuple) -> bytes:
    """Decompress one document's frame and verify its checksum."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    if len(raw) != 4 * entry[3] or zlib.crc32(raw) != entry[4]:
        raise ValueError(f"a frame at {entry[1]} does not match its checksum")
    return raw


def opened(name: str):
    """A file that can be sought in, on any store that Arrow opens by URI."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(name)
    return store.open_input_file(path)


def read_back(spark: SparkSession, folder: str, wanted: set[int] | None = None) -> DataFrame:
    """(path, place, doc_id, n_tokens, ids_crc32, token_ids) of all, or only the wanted, documents of the files.

    A reader seeks: it reads a file's seek table, then the frames that are asked for, and no others.
    """
    columns = ["path", "place", "doc_id", "n_tokens", "ids_crc32", "token_ids"]

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as file:
                    entries = [(k, e) for k, e in enumerate(seek_table(file)) if wanted is None or e[0] in wanted and not e[5]]
                    part, size = [], 0
                    for k, e in entries:
                        file.seek(e[1])
                        raw = document(file.read(e[2]), e)
                        part.append((name, k, None if e[5] else e[0], e[3], zlib.crc32(raw), raw))
                        size += len(raw)
                        if size > 1 << 22:
                            yield rows(part)
                            part, size = [], 0
                    yield rows(part)

    def rows(part):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], kind) for j, kind in enumerate(kinds)], columns)

    # only names travel; one file is one task
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path").distinct()
    return files.mapInArrow(run, "path string, place long, doc_id long, n_tokens long, ids_crc32 long, token_ids binary")


def starts(coded: DataFrame) -> DataFrame:
    """Adds start: ids of all documents before it. Files are summed first, so only one row a file meets in one task."""
    per = coded.groupBy("path").agg(F.sum("n_tokens").alias("t"), F.min("doc_id").alias("least"))
    before = per.select("path", (F.sum("t").over(Window.orderBy(F.col("least").asc_nulls_first(), "path")) - F.col("t")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("path").orderBy("place")) - F.col("n_tokens")
    return coded.withColumn("own", own).join(before, "path").withColumn("start", F.col("before") + F.col("own")).drop("before", "own")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    with scratch(spark):
        folder = f"{shared_folder(spark)}-tokens"
        write(read(spark, sf_dir, "documents").select("doc_id", "text"), folder, P.path("byte_bpe_50k.json"))
        out = cut(starts(cut(read_back(spark, folder).drop("token_ids"))), outer=True)
        delete(spark, folder)
    return out.select("doc_id", F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32")
