"""BPE by distinct words against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from corvane.llm import bpe

END = "<|endoftext|>"
AWKWARD = [
    None, "", " ", "\n\n  \n", "a", " a", "  a", "a  ", "a \n b\t\tc\r\n", f"x{END}y", f"  {END}  {END}", f"a  {END} b", END, END + END, "<|endoftext|", "it's we'll ' s 's", "12 345  6", "é ñ 中文　слово x", "\x85\x1c\x1d ​᠎﻿ z", "\x00\x01 \x00", "a" * 30_000, " " * 5000 + "b", "👍🏽 👨‍👩‍👧", "!?!? ... --", "́a ́",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.TOKENIZER_FILE)
    t.no_padding()
    t.no_truncation()
    return t


def check(rows, library):
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want, r["text"]
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_awkward_texts(spark, library):
    rng = random.Random(3)
    mixed = ["".join(rng.choice(["a", "Z", " ", "  ", "\n", "'s", "7", "!", "é", " ", " ", END, "<|", "\u0085", "½", "ا"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    rows = [(i, t, 1, "x", 2.0) for i, t in enumerate(AWKWARD + mixed)] + [(None, "null id", 1, None, None), (3, "same", 1, "x", 2.0), (3, "same", 1, "x", 2.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, IDS int, Decoded string, score double")
    got = bpe.encode(d.repartition(3), d.columns)
    assert got.columns == ["doc_id", "text", "score", "ids", "decoded"]
    got = got.collect()
    assert len(got) == len(rows)
    check(got, library)
    assert bpe.encode(d.where("false"), ["doc_id"]).count() == 0


def test_words_give_the_text_back():
    special = bpe.special_tokens(bpe.read(bpe.TOKENIZER_FILE))
    assert all("".join(bpe.split_words(t, special)) == t for t in AWKWARD if t)


def test_every_character_is_white_or_not_as_in_the_library(spark, library):
    """Between two letters, each character is split off as the library does it."""
    every = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 997 == 0 or 0xF900 <= c < 0x10400)]
    texts = ["".join(f"a{chr(c)}b{chr(c)} {chr(c)}{chr(c)}c" for c in every[i : i + 50]) for i in range(0, len(every), 50)]
    check(bpe.encode(spark.createDataFrame([(t,) for t in texts], "text string"), ["text"]).collect(), library)


def test_groups(spark, data, library, monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 6000)
    d = spark.read.parquet(f"{data}/documents.parquet")
    check(bpe.encode(d, ["doc_id", "text"]).collect(), library)


def test_decode(spark, library):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(50257) for _ in range(rng.randrange(12))]) for i in range(300)] + [(300, None), (301, []), (302, [50256, 0, 99_999]), (303, [rng.randrange(256) for _ in range(300)])]
    d = spark.createDataFrame(rows, "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(d, ["k"]).collect()}
    assert got == {k: library.decode(ids or [], skip_special_tokens=False) for k, ids in rows}


def test_query(spark, data, library):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {tuple(r) for r in bpe.op12(spark, data).collect()}
    want = set()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == want


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.read("/opt/tokenizers/word_bpe_49k.json")
