"""Token ids as flat binary files with 64-bit document offsets (operator 7).

Format of a file set in one folder, for part p of P (parts follow ascending doc_id):

``part-p.bin``  the ids of the part's documents, little-endian unsigned, 16 bits where the
                vocabulary fits, else 32; every document ends with the end id
``part-p.doc``  the doc_ids, little-endian signed 64 bits (a null id is the least value)
``part-p.len``  the number of ids of each document, little-endian unsigned 64 bits
``part-p.off``  n + 1 offsets, little-endian unsigned 64 bits: where each document starts in
                the ids of all parts, and the end; offsets[0] is the part's base

Writing: documents are range-partitioned and sorted by doc_id; each task encodes its rows
and writes its files under a task-attempt name, then renames them, so a lost or repeated
task leaves one whole file. The task returns one row (part, documents, ids). Prefix sums
over these P rows give the partition bases, and a second pass writes the offsets. Reading
memory-maps the files (other file systems than a local mount are read through pyarrow).

Encoding uses the tokenizers library. Byte-level pre-tokenisation never joins a space that
precedes a letter, digit or ASCII sign to what stands before it, so a text is cut there and
each distinct piece of a task is encoded once; the ids equal those of the whole text.

Defined results: a null text is empty and has only its end id; an empty table writes no
files and reads as no rows; documents of equal doc_id stand next to each other.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import scratch_path
from .common import materialize, releasing, table

END_ID = 0
NULL_ID = -(2**63)
KNOWN = 700_000  # distinct pieces of a generation that a worker remembers
GROUP = 500  # new words encoded in one call of the library
STEP = 200  # texts encoded and written at a time

_CUT = re.compile(r"(?= [\w!-~])")
FIRST = "\0"  # marks a piece without a leading space


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def cut(text: str) -> list[str]:
    """Keys of the pieces of a text, which the pre-tokeniser never joins. A key is a word that a space
    precedes, a line feed with the word after it, or FIRST and the literal piece. Where all
    white space is single spaces and line feeds between printable characters, splitting at the
    spaces is enough; else the text is cut only before a space that a letter, digit or ASCII
    sign follows."""
    if not text:
        return []
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts or "\n " in text or "\n\n" in text or text[-1] == "\n" or not text.replace("\n", "").isprintable():
        return [FIRST + p for p in _CUT.split(text) if p]
    parts[0] = FIRST + parts[0]
    return parts


def piece(key: str) -> str:
    return key[1:] if key[0] == FIRST else key if key[0] == "\n" else " " + key


class PieceEncoder:
    """Encodes texts with a tokenizers model. Every distinct piece is encoded once and kept as the bytes
    of its ids; two generations of pieces bound the memory, and pieces in use stay."""

    def __init__(self, definition: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_str(definition), dtype
        line = self.ids(["\n"])[0]
        self.line_id = line[0] if len(line) == 1 else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, keys: list[str]) -> None:
        # words after a space are encoded many at a time, a line feed between them: it is a token of its own there
        plain = [k for k in keys if k[0] not in "\0\n" and "<|" not in k] if self.line_id is not None else []
        rest = list(set(keys).difference(plain))
        groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)]
        for group, ids in zip(groups, self.ids(["\n".join([" " + k for k in g]) for g in groups]), strict=True):
            a = np.array(ids, self.dtype)
            ends = np.append(np.flatnonzero(a == self.line_id), len(a))
            raw, width, start = a.tobytes(), a.itemsize, 0
            for k, end in zip(group, ends.tolist(), strict=True):
                self.young[k] = raw[start * width : end * width]
                start = end + 1
        for k, ids in zip(rest, self.ids([piece(k) for k in rest]), strict=True):
            self.young[k] = np.array(ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        keys = [cut(t) if t else [] for t in texts]
        if len(self.young) > KNOWN:
            self.old, self.young = self.young, {}
        missing = set().union(*keys).difference(self.young)
        # a letter and the comma or stop after it are never one token: the word is encoded without it
        tailed = [k for k in missing if k[-1] in ",." and k[-2:-1].isalpha()]
        missing.difference_update(tailed)
        missing.update([k[:-1] for k in tailed if k[:-1] not in self.young], [FIRST + t for t in ",." if FIRST + t not in self.young])
        new = []
        for k in missing:
            known = self.old.get(k)
            if known is None:
                new.append(k)
            else:
                self.young[k] = known
        if new:
            self._encode_new(new)
        for k in tailed:
            self.young[k] = self.young[k[:-1]] + self.young[FIRST + k[-1]]
        get = self.young.__getitem__
        return [b"".join(map(get, own)) for own in keys]


def encoder_of(shared: dict) -> PieceEncoder:
    """The worker's encoder: kept with its copy of the broadcast, so the tasks of a worker share it."""
    if "encoder" not in shared:
        shared["encoder"] = PieceEncoder(shared["definition"], shared["dtype"])
    return shared["encoder"]


# -- files -----------------------------------------------------------------------


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class _Files:
    """The files of one part, written under a task-attempt name and renamed when whole."""

    def __init__(self, folder: str, part: int, kinds: list[str]):
        self.fs, self.root = _open(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.part, self.attempt = part, uuid.uuid4().hex
        self.streams = {k: self.fs.open_output_stream(self._name(k, True)) for k in kinds}

    def _name(self, kind: str, temporary: bool) -> str:
        return f"{self.root}/{'.' + self.attempt + '-' if temporary else ''}part-{self.part:06d}.{kind}"

    def write(self, kind: str, values: bytes) -> None:
        self.streams[kind].write(values)

    def commit(self) -> None:
        for kind, stream in self.streams.items():
            stream.close()
            self.fs.move(self._name(kind, True), self._name(kind, False))


def _load(folder: str, part: int, kind: str, dtype: str) -> np.ndarray:
    """A file's values: memory-mapped on a local mount, else read."""
    fs, root = _open(folder)
    name = f"{root}/part-{part:06d}.{kind}"
    if fs.get_file_info(name).size == 0:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, dtype, "r")
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype)


def _write(folder: str, tokenizer, dtype: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, docs, total = TaskContext.get().partitionId(), None, 0, 0
        end = np.array([end_id], dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                if files is None:
                    files, encoder = _Files(folder, part, ["bin", "doc", "len"]), encoder_of(tokenizer.value)
                rows = batch.slice(at, STEP)
                ids = [own + end for own in encoder.encode(rows.column(1).to_pylist())]
                lengths = np.array([len(own) for own in ids], "<u8") // len(end)
                files.write("bin", b"".join(ids))
                files.write("doc", rows.column(0).fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
                files.write("len", lengths.tobytes())
                docs, total = docs + rows.num_rows, total + int(lengths.sum())
        if files is not None:
            files.commit()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([docs]), pa.array([total])], names=["part", "docs", "ids"])

    return run


def _offsets(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lengths = _load(folder, part, "len", "<u8")
                files = _Files(folder, part, ["off"])
                files.write("off", (np.uint64(base) + np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)).astype("<u8").tobytes())
                files.commit()
            yield batch.select([0])

    return run


def _read(folder: str, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                off, docs, ids = _load(folder, part, "off", "<u8"), _load(folder, part, "doc", "<i8"), _load(folder, part, "bin", dtype)
                at = (off - off[0]).astype(np.int64)
                for first in range(0, len(docs), STEP):
                    own = np.asarray(docs[first : first + STEP])
                    edge = at[first : first + len(own) + 1]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_ID), pa.array(off[first : first + len(own)].astype(np.int64)),
                         pa.array(np.diff(edge)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the file set of ``docs`` (doc_id, text) and return its parts (part, docs, ids, base)."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tokenizer = Tokenizer.from_file(tokenizer_path or default_tokenizer())
    dtype = id_type(tokenizer.get_vocab_size())
    shared = spark.sparkContext.broadcast({"definition": tokenizer.to_str(), "dtype": dtype})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    parts = materialize(ordered.mapInArrow(releasing(_write(folder, shared, dtype, end_id)), "part long, docs long, ids long"), "parts")
    # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = materialize(parts.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))), "bases")
    done = _spread(based.select("part", "base")).mapInArrow(_offsets(folder), "part long")
    materialize(done, "offsets")
    return based


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _spread(parts: DataFrame) -> DataFrame:
    """One task per part, as far as parts go round."""
    return parts.repartition(max(1, parts.count()))


def read_tokens(parts: DataFrame, folder: str, vocabulary: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return _spread(parts.select("part")).mapInArrow(
        _read(folder, id_type(vocabulary)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokenizers import Tokenizer

    folder = scratch_path(spark, "token_files")
    parts = write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(parts, folder, Tokenizer.from_file(default_tokenizer()).get_vocab_size())
