import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from memloom.llm import packed_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("vocabulary, bits", [(1, 1), (2, 1), (3, 2), (49_408, 16), (65_537, 17)])
def test_bits(vocabulary, bits):
    assert packed_ids.bits_for(vocabulary) == bits


@given(st.lists(st.integers(0, 2**17 - 1), max_size=300))
def test_packing(ids):
    x = np.array(ids, np.uint32)
    assert packed_ids.unpack(packed_ids.pack(x, 17), 17, len(x)).tolist() == ids


class Sink(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()


@pytest.mark.parametrize("bits", [13, 16])
def test_random_access(bits):
    rng = np.random.default_rng(2)
    docs = [(i, rng.integers(0, 1 << bits, n, dtype=np.uint32)) for i, n in enumerate([5, 0, 100, 1, 64, 333])] + [(None, np.array([7], np.uint32))]
    sink = Sink()
    writer = packed_ids.Writer(sink, bits, block_ids=32)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader = packed_ids.Reader(pa.BufferReader(sink.kept))
    assert [(d, ids.tolist()) for d, _, ids in reader.documents(window=40)] == [(d, ids.tolist()) for d, ids in docs]
    for i in (5, 0, 3, 6):
        assert reader.document(i).tolist() == docs[i][1].tolist()
    with pytest.raises(ValueError):
        packed_ids.Reader(pa.BufferReader(b"x" * 200))


WHOLE = Tokenizer.from_file(PATH)
CODER = packed_ids.WordIds(PATH, remembered=200)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdé'.,!-_ \n\t\x1c\x85\xa0’ßİΣς<|>0"), st.characters()), max_size=60))
def test_chunks_are_whole_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    assert CODER.encode([text])[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids + [1]


def test_query(spark, docs, texts, none):
    rows = packed_ids.pack_and_read(docs, PATH).collect()
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t in order:
        ids = np.array(WHOLE.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == want
    assert packed_ids.pack_and_read(none, PATH).count() == 0


def test_another_tokenizer_gets_whole_texts(spark, tmp_path):
    """A file that keeps case and white space: nothing is looked up by chunk, and the ids are its own."""
    tokenizer = Tokenizer(models.BPE.from_file(*_letters(tmp_path)))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([])
    path = str(tmp_path / "other.json")
    tokenizer.save(path)
    texts = ["ab ba", "Ab  a", "", None, "b a\tb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in packed_ids.pack_and_read(df, path).collect()}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packed_ids.END_ID]
        assert (rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert packed_ids.WordIds(PATH).looks_up and not packed_ids.WordIds(path).looks_up


def _letters(folder):
    """A vocabulary of letters and some merges, as files."""
    (folder / "vocab.json").write_text('{"a": 0, "b": 1, "A": 2, " ": 3, "\\t": 4, "ab": 5, " a": 6}')
    (folder / "merges.txt").write_text("#version: 0.2\na b\n")
    return str(folder / "vocab.json"), str(folder / "merges.txt")
