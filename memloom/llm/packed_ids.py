"""Token ids in files of fixed-width bit-packed blocks, with offsets for random access.

File format, little-endian throughout:

    header    8 bytes magic "MLPACK01", uint32 bits per id, uint32 ids per block
    blocks    each block's ids in the header's bits, least significant bit first, padded to a byte
    documents uint8 id-is-null flags, int64 document ids, uint64 first id of each document (one more than documents)
    offsets   uint64 byte offset of each block (one more than blocks)
    footer    uint64 documents, uint64 ids, uint64 blocks, 8 bytes magic

Every id takes the bits the vocabulary's largest id needs.  A block holds a multiple of 8 ids,
so an id's place is found from its number alone; numpy unpacks whole blocks.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.shared import Scratch, parallelism

MAGIC = b"MLPACK01"
BLOCK_IDS = 1 << 16
END_ID = 1
#: Chunks between white space whose ids a worker remembers at most, twice.
REMEMBERED = 150_000
_FOOTER = struct.Struct("<QQQ8s")
_HEADER = struct.Struct("<8sII")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids, each in so many bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flat.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    """Writes one file, a block at a time; what it keeps in memory is one block and 17 bytes a document."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.at = out.write(_HEADER.pack(MAGIC, bits, block_ids))
        self.waiting: list[np.ndarray] = []
        self.waits = 0
        self.total = 0
        self.docs: list[int | None] = []
        self.firsts = [0]
        self.offsets = [self.at]

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        full = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for i in range(0, full, self.block_ids):
            self.at += self.out.write(pack(ids[i : min(full, i + self.block_ids)], self.bits))
            self.offsets.append(self.at)
        self.waiting, self.waits = [ids[full:]], len(ids) - full

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.waiting.append(ids)
        self.waits += len(ids)
        self.total += len(ids)
        self.firsts.append(self.total)
        if self.waits >= self.block_ids:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        nulls = np.array([d is None for d in self.docs], np.uint8)
        for part in (nulls, np.array([d or 0 for d in self.docs], "<i8"), np.array(self.firsts, "<u8"), np.array(self.offsets, "<u8")):
            self.out.write(part.tobytes())
        self.out.write(_FOOTER.pack(len(self.docs), self.total, len(self.offsets) - 1, MAGIC))
        self.out.close()


class Reader:
    """Random access to a file: any document, or any range of ids, reads only its blocks."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_docs, self.total, n_blocks, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        head, self.bits, self.block_ids = _HEADER.unpack(self._at(0, _HEADER.size))
        if magic != MAGIC or head != MAGIC:
            raise ValueError("not a packed id file")
        length = 17 * n_docs + 8 + 8 * (n_blocks + 1)
        tail = self._at(size - _FOOTER.size - length, length)
        self.null = np.frombuffer(tail, np.uint8, n_docs).astype(bool)
        self.docs = np.frombuffer(tail, "<i8", n_docs, n_docs)
        self.firsts = np.frombuffer(tail, "<u8", n_docs + 1, 9 * n_docs).astype(np.int64)
        self.offsets = np.frombuffer(tail, "<u8", n_blocks + 1, 17 * n_docs + 8).astype(np.int64)

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids with numbers first .. last-1 of the file."""
        if first >= last:
            return np.empty(0, np.uint32)
        a, b = first // self.block_ids, -(-last // self.block_ids)
        count = min(b * self.block_ids, self.total) - a * self.block_ids
        # blocks hold a multiple of 8 ids, so all but the last end on whole bytes and run on
        got = unpack(self._at(self.offsets[a], self.offsets[b] - self.offsets[a]), self.bits, count)
        return got[first - a * self.block_ids : last - a * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.firsts[i], self.firsts[i + 1])

    def documents(self, window: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """All documents in file order (doc_id, first id, ids), reading about a window of ids at once."""
        i = 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(self.firsts, self.firsts[i] + window, "right")) - 1)
            base = self.firsts[i]
            got = self.ids(base, self.firsts[j])
            for k in range(i, j):
                yield None if self.null[k] else int(self.docs[k]), int(self.firsts[k]), got[self.firsts[k] - base : self.firsts[k + 1] - base]
            i = j


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


# The normaliser and pre-tokenizer of tokenizer files whose chunks are looked up.
LOOKED_UP = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class WordIds(dict):
    """Ids of whole texts by the tokenizer.  Where its file lower-cases and drops white space
    (LOOKED_UP), chunks between ASCII white space have the same ids alone as in the text, and
    chunks seen before are looked up; with any other file each text goes to the tokenizer whole.

    The mapping itself is the young generation of chunks; when it is full it becomes the old
    one, and what is asked for again moves back, so that frequent chunks stay.  A run of
    Latin letters is a single word to the tokenizer and goes to its model at once, and so is
    the run of ASCII punctuation behind it; all other chunks go the whole way.
    """

    _PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)")

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        self.looks_up = (form["normalizer"], form["pre_tokenizer"]) == LOOKED_UP and form["post_processor"] is None and form["model"]["type"] == "BPE"
        self.old: dict[str, bytes] = {}
        self.remembered = remembered
        self.letters = _byte_letters()
        self.marks = {m: self.whole(m) for m in (".", ",")}

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            found = self._PLAIN.fullmatch(chunk)
            if found:
                word, mark = found.groups()
                word = word.lower()
                ids = self.get(word) or self.old.get(word) or self._word(word)
                if mark:
                    self[word] = ids
                    if mark not in self.marks and len(self.marks) < 10_000:
                        self.marks[mark] = self.whole(mark)
                    ids += self.marks.get(mark) or self.whole(mark)
            else:
                ids = self.whole(chunk)
        self[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a run of Latin letters, all precomposed: only lower case and the byte alphabet are between it and the model."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > self.remembered:
            self.old = dict(self)
            self.clear()
        known, end, out = self.__getitem__, struct.pack("<I", END_ID), []
        for text in texts:
            if not self.looks_up or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the tokenizer
                data = self.whole(text)
            else:
                data = b"".join(map(known, text.split()))
            out.append(np.frombuffer(data + end, "<u4"))
        return out


#: What a worker process remembers from task to task.
_coders: dict[str, WordIds] = {}


def _write(tokenizer: str, folder: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from memloom.llm.word_hashes import slices

        store, base = pafs.FileSystem.from_uri(folder)
        name, writer, coder = f"{uuid.uuid4().hex}.ids", None, None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(pa.compute.binary_length(texts.cast(pa.binary())).to_pylist(), lambda n: n or 0, 1 << 20):
                coder = _coders.get(tokenizer) or _coders.setdefault(tokenizer, WordIds(tokenizer))
                if writer is None:
                    store.create_dir(base, recursive=True)
                    writer = Writer(store.open_output_stream(f"{base}/{name}"), bits_for(coder.vocabulary()), block_ids)
                part = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                for doc_id, got in zip(ids[a:b], coder.encode(part)):
                    writer.add(doc_id, got)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.total]}, schema=pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_packed(df: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes every whole text and writes the ids below ``folder``, in ascending order of the
    identifier, a file for each range of identifiers.  Returns the manifest (file, n_docs,
    n_ids, part), in the order of part.

    The manifest alone says which files count: a task that runs twice leaves a file nobody
    names.  Null text counts as empty and gives the end id alone.  Null identifiers come
    first; rows that repeat an identifier follow each other in the order of their texts.
    """
    if block_ids % 8:
        raise ValueError("blocks must hold a multiple of 8 ids")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange(parallelism(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    written = ranged.mapInArrow(_write(tokenizer, folder, block_ids), "file string, n_docs long, n_ids long")
    return Scratch(spark, "packed").table(written.withColumn("part", F.spark_partition_id()), "manifest")


def _digests(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base}/{name}") as source:
                    rows = []
                    for doc_id, first, ids in Reader(source).documents():
                        rows.append((doc_id, before + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return run


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, unpacked from the files of the manifest."""
    spark = manifest.sparkSession
    # the manifest has a row for each written file
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", before.alias("before")).repartition(parallelism(spark), "file")
    return files.mapInArrow(_digests(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def pack_and_read(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes all texts of df as packed ids in the shared folder and reads the files' documents back.

    An empty table gives no files and an empty result; other columns of df are ignored.  Texts of
    any length are encoded whole; null and empty texts have the end id alone; of rows that
    repeat an identifier each has its ids.
    """
    folder = f"{Scratch(df.sparkSession, 'ids').root}/files"
    return read_digests(write_packed(df, tokenizer, folder, **options), folder)
