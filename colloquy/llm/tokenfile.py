"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A data file is the 8 bytes ``TOKREC`` 00 and the ids' width, then records

    length of the body   8 bytes, little-endian
    masked crc32 of these 8 bytes
    body: 1 byte (1: the id is null), document id (8 bytes), ids (2 or 4 bytes each)
    masked crc32 of the body

The mask (rotate right by 15 bits, add a constant) keeps checksums of data that
itself holds checksums apart. Beside each data file stands an index file: 24
bytes per record (offset, document id, number of ids), then its masked crc32.
A reader may fetch any record by its offset.
"""

import json
import os
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.common import cut_lineage, filesystem, once, partitions, slices
from colloquy.llm.pretokens import OTHER_SPACE, TextEncoder

MAGIC = b"TOKREC\0"
#: Fixed value: the constant of masked checksums.
MASK = 0xA282EAD8
INDEX = np.dtype([("offset", "<i8"), ("id", "<i8"), ("n", "<i8")])
MEMO_BYTES = 128 << 20   # of the chunks that a worker remembers
JOINED = 64    # chunks that the library encodes in one call


def masked(data: bytes) -> bytes:
    crc = zlib.crc32(data)
    return (((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF).to_bytes(4, "little")


def frame(body: bytes) -> bytes:
    length = len(body).to_bytes(8, "little")
    return b"".join((length, masked(length), body, masked(body)))


def unframe(stream) -> bytes | None:
    """The next record's body; None at the end. Damage is an error."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != head[8:]:
        raise ValueError("damaged record length")
    size = int.from_bytes(head[:8], "little")
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != body[size:]:
        raise ValueError("damaged record")
    return body[:size]


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library; special tokens' strings are ordinary text."""

    def __init__(self, content: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the tasks run side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.encode_special_tokens = True
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        spec = json.loads(content)
        plain = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" \
            and not spec["pre_tokenizer"].get("add_prefix_space")
        self.space = frozenset((" ", *OTHER_SPACE))
        blank = self.library.encode(" a", add_special_tokens=False).tokens[0][:1]
        self.begins = np.zeros(1 << 8 * self.width if self.width == 2 else self.library.get_vocab_size(), bool)
        self.begins[[i for token, i in self.library.get_vocab().items() if token[:1] == blank]] = True
        self.texts = TextEncoder(pattern if plain else None, self.chunks, self.whole, f"<u{self.width}", MEMO_BYTES)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Many chunks in one call: joined, a chunk begins at each id whose token begins with a blank. Those that end in white space go alone."""
        joined = [c for c in chunks if c[:1] == " " and c[-1] not in self.space]
        found, dtype, parts = [], f"<u{self.width}", [joined[at:at + JOINED] for at in range(0, len(joined), JOINED)]
        for part, done in zip(parts, self.library.encode_batch_fast([*map("".join, parts)], add_special_tokens=False)):
            ids = np.array(done.ids, dtype)
            begins = [*(np.flatnonzero(self.begins[ids]) * self.width).tolist(), len(ids) * self.width]
            packed = ids.tobytes()
            if len(begins) != len(part) + 1:
                raise ValueError("the tokenizer does not cut this text at blanks")
            found += [packed[a:b] for a, b in zip(begins, begins[1:])]
        if len(joined) == len(chunks):
            return found
        known = dict(zip(joined, found))
        return [known[c] if c in known else self.whole(c) if c else b"" for c in chunks]

    def __call__(self, texts) -> list[np.ndarray]:
        return self.texts(texts)


def write(df: DataFrame, folder: str, tokenizer: str, pattern: str | None = None, end: int | None = None,
          id_col="doc_id", text_col="text", files: int | None = None) -> DataFrame:
    """Write every text's ids in ascending ``id_col`` order; returns the manifest, a row per file.

    ``tokenizer`` is the content of a tokenizers JSON file. With ``pattern``,
    that file's byte-level pattern, texts are cut at blanks if the pattern
    allows it and each distinct chunk is encoded once while a worker remembers
    it, which gives the ids of the whole text. ``end`` is appended to
    each document. Null texts count as empty; null ids come first; rows with
    equal ids stand in the order of their texts' hashes, so repeated rows give
    the same files in any run. An empty table gives no file. Other columns are
    left out.

    Documents are range-partitioned, sorted and streamed to one file a task.
    File names are new for each attempt and the manifest lists those of tasks
    that ended, so a task that runs twice or dies leaves nothing that is read.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer)  # a vocabulary file: a size that is fixed
    name = hash((tokenizer, pattern))

    def run(batches):
        from pyspark import TaskContext
        import pyarrow as pa

        encoder = once("token files", "library", name, lambda: LibraryEncoder(shared.value, pattern))
        width = encoder.width
        stop = b"" if end is None else end.to_bytes(width, "little")
        part, path, out, index, tokens = TaskContext.get().partitionId(), None, None, [], 0
        for batch in slices(batches):
            for key, found in zip(batch.column(0).to_pylist(), encoder(batch.column(1))):
                if out is None:
                    system, root = filesystem(folder)
                    system.create_dir(root, recursive=True)
                    path = f"{root}/tokens-{part:06d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{path}.bin", buffer_size=1 << 20)
                    out.write(MAGIC + bytes((width,)))
                    at = 8
                ids = found.tobytes() + stop
                record = frame(b"".join((bytes((key is None,)), (key or 0).to_bytes(8, "little", signed=True), ids)))
                out.write(record)
                index.append((at, key or 0, len(ids) // width))
                at += len(record)
                tokens += len(ids) // width
        if out is not None:
            out.close()
            entries = np.array(index, INDEX).tobytes()
            with system.open_output_stream(f"{path}.idx") as side:
                side.write(entries + masked(entries))
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [path.rpartition("/")[2]],
                                              "records": [len(index)], "tokens": [tokens]})

    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    rows = (df.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
            .repartitionByRange(files or partitions(spark), *order).sortWithinPartitions(*order))
    return cut_lineage(rows.mapInArrow(run, "part bigint, file string, records bigint, tokens bigint"))


def read(spark: SparkSession, folder: str, manifest: DataFrame, id_col="doc_id") -> DataFrame:
    """Read the files back: ``id_col``, ``start`` (ids of all documents before it), ``ids`` (packed, 4 bytes each).

    The manifest has a row per file; those rows, and nothing of the documents,
    come to the driver to add up where each file starts.
    """
    files, start = [], 0
    for row in manifest.orderBy("part").collect():
        files.append((row.file, start))
        start += row.tokens

    def run(batches):
        import pyarrow as pa

        system, root = filesystem(folder)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                name, at = files[number]
                keys, starts, packed, held = [], [], [], 0
                with system.open_input_stream(f"{root}/{name}.bin", buffer_size=1 << 20) as stream:
                    head = stream.read(8)
                    if head[:7] != MAGIC:
                        raise ValueError("not a token file")
                    while (body := unframe(stream)) is not None:
                        ids = np.frombuffer(body, f"<u{head[7]}", offset=9)
                        keys.append(None if body[0] else int.from_bytes(body[1:9], "little", signed=True))
                        starts.append(at)
                        packed.append(ids.astype("<u4").tobytes())
                        at += len(ids)
                        held += len(body)
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(packed, pa.binary())], names=[id_col, "start", "ids"])
                            keys, starts, packed, held = [], [], [], 0
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(packed, pa.binary())], names=[id_col, "start", "ids"])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, f"`{id_col}` bigint, start bigint, ids binary")


def record_at(folder: str, file: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record of a file by its place in the index: what a shuffled reader does."""
    system, root = filesystem(folder)
    with system.open_input_file(f"{root}/{file}.idx") as side:
        entries = side.read()
    if masked(entries[:-4]) != entries[-4:]:
        raise ValueError("damaged index")
    with system.open_input_file(f"{root}/{file}.bin") as stream:
        width = stream.read(8)[7]
        stream.seek(int(np.frombuffer(entries[:-4], INDEX)[number]["offset"]))
        body = unframe(stream)
    return None if body[0] else int.from_bytes(body[1:9], "little", signed=True), np.frombuffer(body, f"<u{width}", offset=9)
