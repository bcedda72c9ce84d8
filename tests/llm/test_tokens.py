"""Pieces against the public library, token files against a plain encoding, both through round trips."""
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sigspark.llm import sentence_pieces as p
from sigspark.llm import token_files as f

MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  two  spaces ", "a\n\tb\x00☃ ⁇", "x" * 70, "=" * 200 + " ----", "▁ ▁▁", "Ünïcödé ß 日本語 \U0001f600\U0001f600", "don't we'll 1234567890", " \n \n", "word " * 5000, "ab" * 3000, "²½ᵃ٣Ⅷ", "a b  c d \x1c e", "<|endoftext|> </s> <unk>"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, "c", 5) for k, t in enumerate(texts)] + [(None, "null id", "c", 5), (3, TEXTS[3], "c", 5)], "doc_id long, text string, ids string, block int")


@lru_cache
def table():
    return p.Pieces.of_model(MODEL)


@pytest.fixture(scope="module")
def pieces():
    return table()


def test_encoding_is_the_librarys_and_decodes_back(spark, pieces):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for block in (1 << 25, 500):
        got = p.decode(p.encode(frame(spark), pieces, block), pieces).collect()
        assert len(got) == len(TEXTS) + 2
        for r in got:
            text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
            assert r.ids == library.encode(text), text[:20]
            assert r.text == text.replace("▁", " ")
    assert p.encode(frame(spark).limit(0), pieces).collect() == []


@given(st.text(alphabet=st.one_of(st.sampled_from("abcder  \n.,#1=▁-"), st.characters(exclude_categories=["Cs"])), max_size=40))
@settings(max_examples=300, deadline=None)
def test_units_and_heap_are_the_librarys(text):
    pieces, library = table(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rank, ids = {s: r for s, _, r in pieces.pieces}, {s: i for s, i, _ in pieces.pieces}
    units = re.split(pieces.cuts(), p.SPACE + text.replace(" ", p.SPACE)) if text else []
    got = [i for u in units for s in p._merged(u, rank)[0] for i in ([ids[s]] if s in ids else [pieces.byte_ids[b] for b in s.encode()])]
    assert got == library.encode(text)


def test_viterbi_finds_the_best_score(spark):
    unigram = p.Pieces("unigram", (("a", 300, -3.0), ("b", 301, -3.5), ("ab", 302, -4.0), ("abc", 303, -9.0), ("c", 304, -2.0), ("bc", 305, -4.1), ("▁", 306, -1.0), ("▁a", 307, -2.0)), tuple(range(256)), control=())
    texts = ["abc", "aabbcc ab", "zab", "a" * 80, "", None, "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in p.decode(p.encode(docs, unigram), unigram).collect()}
    score = {s: v for s, _, v in unigram.pieces}
    spell = {i: s for s, i, _ in unigram.pieces}

    def best(t):
        if not t:
            return 0.0
        return max([score[t[:k]] + best(t[k:]) for k in range(1, 4) if t[:k] in score] + ([p._unknown(unigram) + best(t[1:])] if t[0] not in score else []))
    for k in (0, 1, 2, 6):
        ids, at, total = got[k].ids, 0, 0.0
        while at < len(ids):
            total, at = (total + score[spell[ids[at]]], at + 1) if ids[at] in spell else (total + p._unknown(unigram), at + len((texts[k] if k != 2 else "z")[:1].encode()))
        assert np.isclose(total, best("▁" + texts[k].replace(" ", "▁")))
    assert [got[k].text for k in range(7)] == [t or "" for t in texts]


def test_a_table_whose_merges_fall_is_refused():
    with pytest.raises(ValueError):
        p.Pieces("bpe", (("a", 1, 0.0), ("b", 2, 0.0), ("ab", 3, 9.0), ("aba", 4, 2.0)), tuple(range(256)))


def numbers(row):
    return np.frombuffer(row.ids, "<u4").tolist()


@pytest.mark.parametrize("limit", [1 << 17, 8])
def test_token_files_hold_what_the_library_gives(spark, tmp_path, limit):
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    folder = str(tmp_path / "tokens")
    manifest = f.write_token_files(frame(spark), folder, BPE, limit)
    got = f.read_token_files(manifest).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == [None] + sorted(i for i in ids if i is not None) and len(ids) == len(TEXTS) + 2
    at = 0
    for r in got:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert numbers(r) == tokenizer.encode(text, add_special_tokens=False).ids + [2] and r.start == at
        at += len(r.ids) // 4
    file = sorted(os.listdir(folder))[0]
    assert not any(name.endswith(".part") for name in os.listdir(folder))
    reader = f.FileReader(f"{folder}/{file}")
    firsts = [d for d, _ in reader.frame(0)]
    assert [list(x) for x in reader.document(firsts[-1])][0] == next(numbers(r) for r in got if r.doc_id == firsts[-1])
    reader.close()


def test_the_query_gives_the_ids_of_the_library_as_loaded(spark, tmp_path):
    tokenizer = Tokenizer.from_file(BPE)
    texts = [*TEXTS, "a <|endoftext|> b", "<|endoftext|><|endoftext|>é日本 <|endoftext|> \n x", "<|endoftext |>"]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    at = 0
    for r in f.op7_token_files(spark, str(tmp_path)).orderBy("start").collect():
        ids = tokenizer.encode("null id" if r.doc_id is None else texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "a", "é", " ", "\n", "<|"]), max_size=12).map("".join), max_size=4))
@settings(max_examples=100, deadline=None)
def test_added_tokens_are_the_librarys(texts):
    tokenizer = Tokenizer.from_file(BPE)
    assert [np.frombuffer(b, "<u4").tolist() for b in f._encoder(BPE, True).encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_damaged_frame_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    file = f.write_token_files(frame(spark).where("doc_id = 9"), folder, BPE).first().file
    reader = f.FileReader(file)
    reader.entries = reader.entries.copy()
    reader.entries["checksum"][0] ^= 1
    with pytest.raises(ValueError):
        list(reader.frame(0))
    assert f.write_token_files(frame(spark).limit(0), str(tmp_path / "none"), BPE).collect() == []


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'st 12  \n.,#éß×\t\x1c"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
@settings(max_examples=200, deadline=None)
def test_pieces_of_a_text_encode_apart(texts):
    encoder = f._encoder(BPE)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_remembered_word_is_not_split_again_before_other_signs():
    encoder = f.Encoder(BPE, True)
    model, asked = encoder.model, []

    class Counting:
        def tokenize(self, text):
            asked.append(text)
            return model.tokenize(text)
    encoder.model = Counting()
    encoder.encode(["x können vitreré ortion &&& .\nDe"])
    asked.clear()
    texts = ["x können, können&&& können.\nDe vitreré vitreré. vitreré*** ortion&&&"]
    ids = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    assert ids == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not any(len(t) > 5 for t in asked)


def test_common_words_are_looked_up_as_they_stand(pieces):
    reader = p._Reader(pieces)
    by_word, by_unit = reader.by_first({"▁the": b"1", "▁": b"2", "ing": b"3", ",": b"4", "▁▁": b"5"})
    assert by_word == {"the": b"1", "": b"2", "▁": b"5"} and by_unit == {"ing": b"3", ",": b"4"}
    assert all(reader.units_of_word(w) == ["▁" + w] for w in ("the", ""))
    plain = p._Reader(p.Pieces("unigram", (("a", 300, -3.0),), tuple(range(256)), prefix=False, control=()))
    assert plain.by_first({"▁a": b"1", "a": b"2"}) == ({}, {"▁a": b"1", "a": b"2"})
