import random
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.helpers import SMALL, TEXTS, documents
from tillbook.llm import sp_viterbi, token_counts, token_files
from tillbook.llm.common import byte_slices, release_codecs
from tillbook.llm.tokenizer_files import Memo, public

BYTE, WORD, PIECE = (public(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SPACE_TEXTS = [(50, "a   b"), (51, "a \n \n b\n"), (52, "\n\n a"), (53, "tab\t tab \t"), (54, "  lead and trail  "),
               (55, "<|endoftext|><|endoftext|> x <|endoftext|>"), (56, " a  b\xa0 c"), (57, "don't 've  'S\n's"),
               (58, "<|startoftext|>Hello"), (59, "é ́ ạ̀"), (60, "\r\n\r\n x\r")]
PARTS = [*"ab '.\n\t  é中1<|>▁", "the", " in", "'s", "  ", "\U0001d54f", "<|endoftext|>"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTE)
    rows = TEXTS + SPACE_TEXTS + small(spark)
    got = token_counts.token_counts(documents(spark, rows), BYTE).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in got])) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(documents(spark, []), BYTE).count() == 0


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_of_random_texts(text):
    library = token_counts.load(BYTE)
    assert token_counts.counter(BYTE).count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_whole_tokens_are_proven():
    c, library = token_counts.counter(BYTE), Tokenizer.from_file(BYTE)
    sample = random.Random(1).sample(sorted(c.whole), 2000)
    assert len(c.whole) > 40_000 and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in sample)


def test_memo_is_bounded():
    memo = Memo(lambda k: k * 2, 10)
    assert [memo[i] for i in range(35)] == [2 * i for i in range(35)] and len(memo) <= 10


def test_token_files_equal_the_library(spark):
    library = Tokenizer.from_file(WORD)
    rows = TEXTS + SPACE_TEXTS + small(spark)
    got = token_files.token_files_digest(documents(spark, rows), WORD, 2).orderBy("start").collect()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert token_files.token_files_digest(documents(spark, []), WORD, 2).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=0, max_size=400), st.integers(0, 3))
def test_elias_fano_round_trip(gaps, low):
    values = np.concatenate([[0], np.cumsum(np.array(gaps, np.int64) * low)]).astype(np.int64)
    ef = token_files.EliasFano.encode(values)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def test_token_files_of_any_folder_form_and_a_hot_id(spark, tmp_path):
    """``/x``, ``file:/x`` and ``file:///x`` name one folder; one id's rows fill several shards, in reruns alike."""
    library = Tokenizer.from_file(WORD)
    rows = [(7, f"text number {i} of one id") for i in range(400)] + [(8, "after"), (6, "before")]
    want = sorted(zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")) for _, t in rows)
    seen = []
    for form in (f"{tmp_path}/a", f"file:{tmp_path}/b", f"file://{tmp_path}/c"):
        files = token_files.write_token_files(documents(spark, rows), WORD, form, 2, shards=4).collect()
        assert sum(f.n_docs for f in files) == len(rows) and max(f.n_docs for f in files) < 200
        got = token_files.read_token_files(spark, form).orderBy("start").collect()
        assert [r.doc_id for r in got] == [6, *[7] * 400, 8]
        assert sorted(r.ids_crc32 for r in got) == want
        assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
        seen.append([(r.doc_id, r.ids_crc32) for r in got])
    assert seen[0] == seen[1] == seen[2]


def test_shard_gives_documents_in_little_space():
    counts = np.array([3, 0, 5, 1000, 1])
    ids = np.arange(counts.sum(), dtype="<u2")
    shard = token_files.Shard(token_files.encode_shard(ids.tobytes(), counts, np.array([4, 5, 6, 7, 8]), np.zeros(5, bool), 2))
    assert [len(shard.document(i)) for i in range(5)] == counts.tolist()
    assert shard.document(2).tolist() == [3, 4, 5, 6, 7]
    many = np.full(100_000, 500)
    ef = token_files.EliasFano.encode(np.concatenate([[0], np.cumsum(many)]))
    assert (len(ef.lows) + len(ef.highs)) * 8 / 100_000 < 12          # 64 bits in a plain table


def test_pieces_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = TEXTS + SPACE_TEXTS + small(spark)
    encoded = sp_viterbi.encode(documents(spark, rows).drop("ids"), PIECE)
    got = sp_viterbi.decode(encoded, PIECE).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "")
        assert r.ids == ids
        assert r.decoded == (r.text or "").replace("▁", " ")
    want = []
    for i, t in rows:
        ids = np.array(library.encode(t or ""), "<i4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes()), "▁" not in (t or "")))
    assert sorted(map(str, map(tuple, sp_viterbi.digest(documents(spark, rows), PIECE).collect()))) == sorted(map(str, want))
    assert sp_viterbi.encode(documents(spark, []), PIECE).count() == 0
    assert sp_viterbi.digest(documents(spark, []), PIECE).count() == 0


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pieces_of_random_texts(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert np.frombuffer(sp_viterbi.codec(PIECE).encode(text), "<i4").tolist() == library.encode(text)


def test_streaming_commits_early_and_whatever_the_portions():
    pieces = sp_viterbi.codec(PIECE).pieces
    text = "▁the▁international" * 200 + "x" * 500
    whole = sp_viterbi.StreamingEncoder(pieces)
    want = whole.feed(text) + whole.finish()
    stream, got, widest = sp_viterbi.StreamingEncoder(pieces), [], 0
    for i in range(0, len(text), 7):
        got += stream.feed(text[i:i + 7])
        widest = max(widest, len(stream.window))
    got += stream.finish()
    assert got == want and [pieces.name(n) for n in got] == pieces.merge(text) and widest <= 3 * pieces.longest + 7


def test_batches_are_cut_by_bytes():
    texts = ["é" * 30, None, "", "x" * 500, "y", "z" * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    parts = list(byte_slices(iter([batch, batch.slice(0, 0)]), "text", 100))
    assert [p.column(1).to_pylist() for p in parts] == [["é" * 30, None, ""], ["x" * 500], ["y", "z" * 20]]
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def test_codecs_are_released():
    """What one operator's tasks keep in a worker goes when another operator's begin."""
    path = public("piece_bpe_32k.model")
    first = sp_viterbi.codec(path)
    assert sp_viterbi.codec(path) is first
    release_codecs()
    assert sp_viterbi.codec.cache_info().currsize == 0 and sp_viterbi.codec(path) is not first
