"""Packing and token files: exact round trips against the library's own encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyfield.llm import packing, token_files
from tallyfield.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library_ids(path, texts):
    t = Tokenizer.from_file(path)
    return [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("path", "drops"), [(WORD, True), (BYTE, False)])
def test_encoder_is_the_library(path, drops):
    rng = random.Random(3)
    signs = ["abc XYZ'sStTdDmM,.!? \n\t-_09²½ªºµßéÉİſ", "".join(map(chr, range(32, 0x250))), "a \n\t\r 　\x1c\x85É漢字'İ<|endoftext|>🙂́Å", "\n a."]
    texts = ["".join(rng.choice(s) for _ in range(rng.randrange(40))) for s in signs for _ in range(300)]
    texts += ["", " ", "\n", "  a", "a  ", "\n\n a", "a \nb", "it's they'LL", "x,'s", "foo.\nBar baz\n"]
    enc = Encoder(path, drops)
    for text, ids in zip(texts, library_ids(path, texts), strict=True):
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == ids[:-1], repr(text)


@pytest.mark.parametrize(("path", "drops"), [(WORD, True), (BYTE, False)])
def test_added_tokens_are_the_library_s(path, drops, docs):
    texts = ["end of doc <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>b\n\n c", "<|startoftext|>It's\x1c<|endoftext|>", "It's<|ENDOFTEXT|>x it's<|StartOfText|>é", "<|endoftext|", "<| endoftext |>", "漢<|EndOfText|>"]
    wanted = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    enc = Encoder(path, drops)
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == wanted
    rows = packing.pieces(docs(*enumerate(texts)), path, drops).collect()
    assert [sum((np.frombuffer(r["ids"], "<u4").tolist() for r in rows if r["doc_id"] == i), []) for i in range(len(texts))] == [[*x, 2] for x in wanted]


def test_tables_start_anew(monkeypatch):
    from tallyfield.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 3)
    texts = ["one two three four five six, seven", "one two one"]
    enc = Encoder(BYTE, False)
    assert [[*np.frombuffer(x, "<u4").tolist(), 2] for x in enc.encode(texts)] == library_ids(BYTE, texts)


def test_marks_are_cut_off():
    rng = random.Random(5)
    signs = ["aZ9é.,", "ab ., \n", "aéȀɏɐж漢ªµº×÷²½İ'.,\x01 ", "x0.,;!?\"')»”- ", "ab1.,é  \n\t"]
    texts = ["".join(rng.choice(s) for _ in range(rng.randrange(30))) for s in signs for _ in range(600)]
    texts += [f"{chr(c)}{m}{chr(c)} {chr(c)}{m} {m}{chr(c)}\n{chr(c)}{m}" for c in range(1, 0x260) for m in ".,"]
    texts += ["1,000.50, x", "...", "a...", "a.,b", "a, b.\nC.", ",a", " .", "a\x01.", "\x01", " \x01,", "a \x01,b", "e.g., it's, 's. <|endoftext|", "x.<|endoftext|>,y."]
    enc = Encoder(BYTE, False)
    assert [[*np.frombuffer(x, "<u4").tolist(), 2] for x in enc.encode(texts)] == library_ids(BYTE, texts)


def test_words_are_merged_once_whatever_mark_follows(monkeypatch):
    from tallyfield.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 60)
    words = ["".join(x) for x in zip("abcde" * 10, "fghij" * 10, "klmnopqrst" * 5, sorted("uvwxy" * 10), strict=True)]
    texts = [" ".join(w + mark for w in ["x", *words]) for mark in ("", ",", ".", ",") * 3]
    enc, merged = Encoder(BYTE, False), []
    plain = enc._merged
    monkeypatch.setattr(enc, "_merged", lambda signs: merged.append(signs) or plain(signs))
    assert [[*np.frombuffer(x, "<u4").tolist(), 2] for x in enc.encode(texts)] == library_ids(BYTE, texts)
    assert len(merged) == len(set(merged)) <= len(set(words)) + 1  # a table of 60 that keeps words with their marks merges some again


def test_binary_lengths():
    assert packing.binary_lengths(1) == [1]
    assert packing.binary_lengths(4096 * 2 + 5) == [4096, 4096, 4, 1]
    assert all(sum(packing.binary_lengths(n, 64)) == n for n in range(1, 300))


def check_packed(df):
    rows = packing.packed(df, WORD).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    wanted = sorted((str(d), tuple(ids)) for (d, _), ids in zip(texts, library_ids(WORD, [t for _, t in texts]), strict=True))
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and r["offset"] == 0
        pieces.setdefault((str(r["doc_id"]), r["start"]), []).append((tuple(ids.tolist()), r["doc_tokens"]))
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    by_sequence = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_sequence] == sorted((r["length"] for r in rows), reverse=True)
    return wanted, pieces


def test_whole_table_round_trip(spark):
    wanted, pieces = check_packed(spark.read.parquet(f"{SF}/documents.parquet"))
    for doc, ids in wanted:
        at = 0
        while at < len(ids):
            part, total = pieces[doc, at].pop()
            assert part == ids[at : at + len(part)] and total == len(ids)
            at += len(part)


def test_packing_odd_rows(odd):
    wanted, pieces = check_packed(odd)
    assert sum(len(x) for x in pieces.values()) == sum(len(packing.binary_lengths(len(ids))) for _, ids in wanted)
    assert packing.packed(odd.limit(0), WORD).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pieces(odd, WORD, longest=1000)


def test_token_files_round_trip(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"]) for r in df.collect())
    wanted, start = [], 0
    for (doc, _), ids in zip(texts, library_ids(BYTE, [t for _, t in texts]), strict=True):
        wanted.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.token_table(df, BYTE).collect()) == wanted


def test_one_document_without_the_others(spark, docs, tmp_path):
    path = f"file://{tmp_path}/files"
    manifest = token_files.write_token_files(docs((3, "three"), (1, "one word"), (2, "two")), path, BYTE)
    _, dictionary = token_files.read_manifest(path)
    got = {}
    for s in manifest["shards"]:
        shard = token_files.Shard(f"{path}/{s['file']}", dictionary)
        got |= {int(x["doc_id"]): shard.document(k).tolist() for k, x in enumerate(shard.index)}
    assert got == dict(zip((3, 1, 2), library_ids(BYTE, ["three", "one word", "two"]), strict=True))
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Shard(f"{path}/{manifest['shards'][0]['file']}", b"other")


def test_token_files_odd_rows(odd):
    rows = token_files.token_table(odd, BYTE).orderBy("start").collect()
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    wanted = sorted((str(d), len(i)) for (d, _), i in zip(texts, library_ids(BYTE, [t for _, t in texts]), strict=True))
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == wanted
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in texts), key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert token_files.token_table(odd.limit(0), BYTE).count() == 0
