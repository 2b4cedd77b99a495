"""Byte-level BPE encoding and decoding with a published vocabulary.

A text is cut at the added tokens, then into words by the vocabulary's pattern. A word's bytes are symbols in a doubly
linked list; the merges that are possible wait in a priority queue, lowest rank first, leftmost first among equals. A
merge that is taken joins two neighbours and queues the pairs that arise; entries whose symbols have changed since are
stale and skipped. Decoding concatenates the vocabulary's byte strings.

Words recur, so each Python worker keeps the ids of up to ``CACHED_WORDS`` words, and starts anew when that is full:
memory is bounded, and the result does not depend on it. The vocabulary (of fixed size) is broadcast as the file's bytes.
Each row is encoded on its own; nothing is shuffled.

Defined cases: a null text counts as the empty text, which has no ids; a null or repeated id is passed through; the text
of an added token in a document becomes that token; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import named, pieces

#: Words that a worker keeps, and the longest that it keeps.
CACHED_WORDS, CACHED_LENGTH = 1 << 18, 48

#: White space as Unicode has it, which Python's own class is not.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for texts of common characters only, for which the classes of the standard library agree.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile(r"[^\t-\r -~\xa1-\xb1\xb4\xb6-\xb8\xbb\xbf-\u024f\u2010-\u2027\u2030-\u203e]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself where it prints, else the next above 255."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class Codec:
    """Encodes and decodes by the contents of a ``tokenizer.json`` of the byte-level kind."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are read")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens") or ()):
            raise ValueError("added tokens that take the space around them are not read")
        vocab = model["vocab"]
        size = 1 + max(chain(vocab.values(), self.added.values()))
        self.bytes_of = [b""] * size
        for letter_string, k in vocab.items():
            self.bytes_of[k] = bytes(map(letters.__getitem__, letter_string))
        for content, k in self.added.items():
            self.bytes_of[k] = content.encode()
        self.digits_of = [str(k) for k in range(size)]
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.size = size
        #: left * size + right -> (rank, merged)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] * size + vocab[b], (rank, vocab[a + b]))
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids that a word's symbols become."""
        n, size, find = len(symbols), self.size, self.merges.get
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(found[0], i, found[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := find(symbols[i] * size + symbols[i + 1]))]
        heapify(queue)
        while queue:
            _, i, merged, a, b = heappop(queue)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:  # stale
                continue
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := find(merged * size + symbols[k]):
                    heappush(queue, (found[0], i, found[1], merged, symbols[k]))
            h = before[i]
            if h >= 0 and (found := find(symbols[h] * size + merged)):
                heappush(queue, (found[0], h, found[1], symbols[h], merged))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.merge(list(map(self.of_byte.__getitem__, word.encode()))))
        if len(word) <= CACHED_LENGTH:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def plain(self, text: str) -> list[int]:
        """The ids of a text without added tokens."""
        words = (WORDS if NOT_PLAIN.search(text) else PLAIN_WORDS).findall(text)
        get, new = self.cache.get, self.word
        return list(chain.from_iterable([get(w) or new(w) for w in words]))

    def encode(self, text: str) -> list[int]:
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        ids, at = [], 0
        for m in self.cut.finditer(text):
            ids += self.plain(text[at : m.start()])
            ids.append(self.added[m.group()])
            at = m.end()
        return ids + self.plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(raw: bytes) -> Codec:
    """One codec a vocabulary and Python process."""
    name = hashlib.sha256(raw).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(raw)
    return _codecs[name]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids_col``, the ids of ``text_col``, in place of a column of that name."""
    raw = _vocabulary(docs, path)

    @F.pandas_udf("array<int>")
    def ids(texts):
        one = codec(raw.value)
        return texts.fillna("").map(one.encode)

    return docs.withColumn(ids_col, ids(named(text_col)))


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``text_col``, the text that the ids stand for; null ids give the empty text."""
    raw = _vocabulary(encoded, path)

    @F.pandas_udf("string")
    def texts(ids):
        one = codec(raw.value)
        return ids.map(lambda x: one.decode([] if x is None else x))

    return encoded.withColumn(text_col, texts(named(ids_col)))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: how many ids its text has, and the SHA-256 of them and of the text decoded again."""
    raw = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(raw.value)
        digits, sha = one.digits_of.__getitem__, hashlib.sha256
        for batch in pieces(batches):
            lengths, encoded, decoded = [], [], []
            for text in batch.column(1):
                ids = one.encode(text.as_py() or "")
                lengths.append(len(ids))
                encoded.append(sha(",".join(map(digits, ids)).encode()).hexdigest())
                decoded.append(sha(one.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(lengths, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, DIGEST)
