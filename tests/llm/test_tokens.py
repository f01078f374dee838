"""Packing and token files against the tokenizer itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from conftest_llm import prose
from patronage.llm import packing, token_files, tokens

PATH = tokens.public_file()
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\t x", "it's  we'll 's", "é è ñ ü ß", "日本 語 です", "a b　c", "\x1c a\x1d b \x85 c", "12 345 ² ³ ½",
    "!!! ??? ...", "<|endoftext|> x", "x" * 5000, "a " * 3000, " \n".join("word%d" % i for i in range(400)), "𝒳 😀😀 x", "a\r\nb\r c", " ", "Ġ Ċ ĉ", "don't stop 'til",
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(plain):
    rnd = random.Random(1)
    letters = "abc \n\t'.,!é1ñ日  ½"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(1500)]
    small = tokens.Encoder(PATH, cache=8)
    for enc in (tokens.encoder(PATH), small):
        for text in texts:
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain(text), text


def _table(documents, rnd):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, prose(rnd, rnd.randrange(60))) for i in range(60)]
    rows += [(7, "a"), (None, "null id"), (None, None), (200, prose(rnd, 4000)), (200, "same id")]
    return rows, documents(rows).repartition(5)


def test_packing(documents, plain, rnd):
    rows, df = _table(documents, rnd)
    got = packing.pack(df, PATH, window=64).collect()
    ids = {}
    for doc, text in rows:
        ids.setdefault(doc, []).append(plain(text) + [0])
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    assert sorted(sequences) == list(range(len(sequences)))
    for number, pieces in sequences.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == 64 or number == len(sequences) - 1


def test_packing_a_document_in_order(documents, plain):
    text = "word " * 700
    got = sorted(packing.pack(documents([(5, text)]), PATH, window=128).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == list(range(0, len(plain(text)) + 1, 128))
    assert [r["sequence_id"] for r in got] == list(range(len(got)))


def test_empty_tables(spark, documents, tmp_path):
    empty = documents([])
    assert packing.pack(empty, PATH).count() == 0
    token_files.write_tokens(empty, f"{tmp_path}/t", PATH)
    assert token_files.read_documents(spark, f"{tmp_path}/t").count() == 0
    assert token_files.read_tokens(spark, f"{tmp_path}/t", spark.range(3).withColumnRenamed("id", "position")).count() == 0


def test_token_files_round_trip(spark, documents, plain, rnd, tmp_path):
    rows, df = _table(documents, rnd)
    token_files.write_tokens(df, f"{tmp_path}/t", PATH, block_ids=500)
    got = sorted(token_files.read_documents(spark, f"{tmp_path}/t").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    at, stream = 0, []
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(r["ids"]))
        assert ids.tolist() in [plain(t) + [0] for d, t in rows if d == r["doc_id"]]
        at += len(ids)
        stream += ids.tolist()
    asked = spark.createDataFrame([(p,) for p in [*range(0, at, 7), at - 1, at, -1, None, 0]], "position bigint")
    found = token_files.read_tokens(spark, f"{tmp_path}/t", asked).collect()
    assert sorted((r[0], r[1]) for r in found) == [(p, stream[p]) for p in sorted({*range(0, at, 7), at - 1})]


def test_codes_of_any_width(rnd):
    ids = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1] * 400 + [rnd.randrange(1 << rnd.randrange(1, 33)) for _ in range(5000)], "<u4")
    levels, bitmaps, ranks = token_files.encode_block(ids)
    assert len(levels) == 4 and (token_files.decode_block(len(ids), levels, bitmaps) == ids).all()
    assert all(token_files.token_at(i, levels, bitmaps, ranks) == ids[i] for i in range(0, len(ids), 13))


def test_new_words_of_a_batch_are_encoded_together(plain, monkeypatch):
    rnd = random.Random(2)
    letters = "abcdeé1.,'\nĠ"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))).strip() or "a" for _ in range(2000)]
    texts = [" ".join(words[low:low + 100]) for low in range(0, len(words), 100)]
    enc, alone = tokens.Encoder(PATH), []
    monkeypatch.setattr(enc, "_after_space", alone.append)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_many(pa.array(texts))] == [plain(t) for t in texts]
    assert not alone
    small = tokens.Encoder(PATH, cache=8)
    odd = [t or "" for t in ODD] + ["日本 語" * 30 + " x", "a " + "y" * 100 + " b"] + texts
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_many(pa.array(odd))] == [plain(t) for t in odd]


def test_new_words_skip_the_pattern_of_the_library(plain, monkeypatch):
    """The words of a batch are cut together and go to the model; the tokenizer does not cut them a second time."""
    enc = tokens.Encoder(PATH)
    monkeypatch.setattr(enc, "tokenizer", None)
    texts = ["It's the\nnewword newword, l'été 12,5 ½ of\t\tthe «x»", "of. of, of\r\n\nof newword"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_many(pa.array(texts))] == [plain(t) for t in texts]


def test_added_words_of_a_file(tmp_path):
    library = Tokenizer.from_file(PATH)
    library.add_tokens(["bcd"])
    library.save(f"{tmp_path}/t.json")
    texts = ["abcde bcd, abcde bcd", "bcd x"]
    found = tokens.Encoder(f"{tmp_path}/t.json").encode_many(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
