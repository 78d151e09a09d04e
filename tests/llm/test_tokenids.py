import io
import json
import zlib

import helpers as H
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailspark.llm import idfile, queries, tokenids

JSON = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
BYTES_JSON = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
TOK = Tokenizer.from_str(JSON)


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 11, 15, 16, 17, 20, 31, 32])
def test_packing_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 3001).astype(np.uint32)
    data = idfile.pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8)
    for first, last in ((0, 3001), (0, 0), (17, 18), (1234, 3001), (2999, 3000)):
        assert (idfile.unpack(data, first, last - first, width) == ids[first:last]).all()
    bits = "".join(format(int(i), f"0{width}b")[::-1] for i in ids)  # low bits first
    assert "".join(format(b, "08b")[::-1] for b in data).startswith(bits)


def test_width_of_vocabulary():
    assert [idfile.width_of(n) for n in (1, 2, 3, 32_000, 32_768, 32_769, 49_408, 65_536, 65_537)] == [1, 1, 2, 15, 15, 16, 16, 16, 17]


class Kept(io.BytesIO):
    def close(self):
        self.data = self.getvalue()


@pytest.mark.parametrize("block", [8, 13, 1 << 16])
def test_file_round_trip(block):
    rng, out = np.random.default_rng(block), Kept()
    docs = [(k if k % 5 else None, rng.integers(0, 30_000, n).astype(np.uint32)) for k, n in enumerate([0, 1, 7, 8, 9, 100, 0, 13, 26, 3])]
    w = idfile.Writer(out, 15, block)
    for d, x in docs:
        w.add(d, x)
    w.close()
    f = idfile.Reader(io.BytesIO(out.data))
    assert [None if m else int(i) for i, m in zip(f.doc_ids, f.nulls, strict=True)] == [d for d, _ in docs]
    for k in (3, 0, 9, 5, 8):
        assert (f.document(k) == docs[k][1]).all()
    everything = np.concatenate([x for _, x in docs])
    assert (f.ids(0, f.n_ids) == everything).all() and (f.ids(20, 41) == everything[20:41]).all()
    joined = {}
    for k, x in f.stretches():
        joined[k] = np.concatenate([joined.get(k, x[:0]), x])
    assert all((joined[k] == x).all() for k, (_, x) in enumerate(docs))
    assert sum(np.diff(f.offsets)) == f.offsets[-1] and len(f.offsets) == -(-len(everything) // block) + 1
    with pytest.raises(ValueError):
        idfile.Reader(io.BytesIO(out.data[:-1] + b"?" * 9))
    with pytest.raises(ValueError):
        w.add(1, np.array([1 << 15], np.uint32))


ODD = ["It's 12.5%, isn't   it?", "<|endoftext|>x <|startoftext|>", "ÉCOLE école École! ́x é K Å  a b İ ẞß ﬁ", "a\x1cb\x85c d", "don't we've 'S x'S", "...!? ;a; a;b",
       "퟿\U0001f600中文 тест ТЕСТ", "naïve.. ÿ× ÷ª º µ", "\x00 \x00a"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60) | st.sampled_from(ODD) | st.text("aAéÉñ.,'s \n9́<|>", max_size=40), max_size=6))
def test_words_give_the_ids_of_whole_texts(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    got = tokenids.encoder(JSON, 2, True).encode([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [[*e.ids, 2] for e in TOK.encode_batch(texts, add_special_tokens=False)]


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenids, "CACHE_WORDS", 5)
    enc = tokenids.WordEncoder(JSON, 2)
    for t in ("one two, Three four. five six", "seven One two", "Three, six eight"):
        assert enc.encode([t.encode()])[0].tolist() == [*TOK.encode(t, add_special_tokens=False).ids, 2]


def plain(rows, tok, end):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out, at = [], 0
    for i, t in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_plain_encoding(spark, tmp_path):
    rng = H.rng(3)
    texts = H.odd_texts() + ODD + [" ".join(H.words(rng, rng.randrange(0, 90))) for _ in range(120)]
    rows = [(3 * k % 1009, t) for k, t in enumerate(texts)]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_token_ids(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in out.collect()) == sorted(plain(rows, TOK, 2))


def test_null_and_repeated_ids_come_in_a_fixed_order(spark):
    rows = [(None, "a b"), (5, "x"), (None, "a b"), (5, "x"), (5, "y z"), (1, None), (None, None), (-7, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokenids.read_ids(tokenids.write_ids(df, JSON, 2, by_word=True)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [-7, 1, 5, 5, 5, None, None, None]
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(8)]
    assert sorted(r.ids_crc32 for r in got) == sorted(x[3] for x in plain(rows, TOK, 2))
    again = tokenids.read_ids(tokenids.write_ids(df.repartition(3), JSON, 2, by_word=True)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.ids_crc32) for r in again] == [(r.doc_id, r.start, r.ids_crc32) for r in got]
    empty = tokenids.write_ids(df.limit(0), JSON, 2)
    assert empty.count() == 0 and tokenids.read_ids(empty).count() == 0


def test_another_tokenizer_whole_texts_small_blocks(spark):
    rng = H.rng(6)
    rows = [(k, " ".join(H.words(rng, 40))) for k in range(50)] + [(50, "word " * 20_000)]
    manifest = tokenids.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), BYTES_JSON, 50256, file_bytes=4000, block=999)
    tok = Tokenizer.from_str(BYTES_JSON)
    assert sorted(tuple(r) for r in tokenids.read_ids(manifest).collect()) == plain(rows, tok, 50256)
    assert manifest.agg(F.sum("n_docs")).first()[0] == 51 and manifest.count() > 5
    assert json.loads(BYTES_JSON)["model"]["type"] == "BPE"


def test_running_start_over_groups(spark):
    df = spark.createDataFrame([(k, k % 4) for k in range(0, 60, 3)], "part long, n_ids long")
    at = 0
    for r in tokenids.running_start(df, group=7).orderBy("part").collect():
        assert r["first"] == at
        at += r.n_ids
