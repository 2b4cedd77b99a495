import hashlib
import random

import pytest
from tokenizers import Tokenizer

from lamella.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read())


def texts():
    chance = random.Random(7)
    pools = ["abc dEf's 12,.!", "ab \t\n\r\x0b\x0c\x1c\x1d\x1f\x85\xa0   　", "é²½Ⅷªº٣µ×÷ß_-", "漢字かなñ😀👍🏽‍́﻿", "'s't're've'm'll'd 'S'T"]
    for _ in range(400):
        pool = "".join(chance.sample(pools, chance.randint(1, 5)))
        yield "".join(chance.choice(pool) for _ in range(chance.randint(0, 60)))
    yield from ["", " ", "  a", "a  ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endof", "a" * 3000, "the " * 2000, "\x00\x01\x7f", "x" * 500 + "é" * 500]


def test_ids_and_text_as_the_library(codec, library):
    for text in texts():
        ids = codec.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_lowest_rank_first_then_leftmost():
    raw = b'{"added_tokens": [], "pre_tokenizer": {"type": "ByteLevel"}, "model": {"type": "BPE", "vocab": {%s, "ab": 300, "bc": 301, "aa": 302}, "merges": ["b c", "a b", "a a"]}}'
    letters = ", ".join(f'"{chr(c) if chr(c) not in chr(34) + chr(92) else chr(92) + chr(c)}": {b}' for c, b in ((ord(k), v) for k, v in bpe.byte_letters().items()))
    small = bpe.Codec(raw.replace(b"%s", letters.encode()))
    assert small.encode("abc") == [97, 301]
    assert small.encode("aaa") == [302, 97]
    assert small.encode("ab") == [300]


def test_full_cache_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    text = "one two three four five six one two three"
    assert codec.encode(text) == library.encode(text).ids


def test_digests_rows(spark, library):
    rows = [(1, None, "x"), (1, "Hello there", "y"), (None, "Hello there", "z"), (2, "", None), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = library.encode("Hello there").ids
    full = (len(ids), sha(",".join(map(str, ids))), sha("Hello there"))
    assert found == sorted([(1, 0, sha(""), sha("")), (1, *full), (0, *full), (2, 0, sha(""), sha("")), (2, 0, sha(""), sha(""))])
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_columns_round_trip(spark):
    docs = spark.createDataFrame([(1, "naïve <|endoftext|> ☕"), (2, None)], "doc_id long, text string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == ["naïve <|endoftext|> ☕", ""]
    assert out[1].token_ids == []
