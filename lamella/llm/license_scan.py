"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

One automaton finds which of all rules' keywords a text holds; only the rules whose keywords are all there are tried.
Of the matches, one that lies inside another of a higher priority is suppressed, and of equal priority the one inside
the longer (the same span: the earlier rule's stays). Matches that overlap without containment both stay.

Beside the rules there are base phrases, words that stand one after another: their places are counted in words, and
their labels stay whatever the rules say. Each row is scanned on its own; nothing is shuffled.

Defined cases: a null text counts as the empty text, which has no words, labels or places and score 0; a null or
repeated id is passed through; an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import named, pieces
from lamella.llm.license_rules import Rule, rules

#: Words of a phrase, and its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The score of a base phrase alone.
PHRASE_SCORE = 0.5
#: A-Z to lower case; what ends a word to blanks. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
WORD_BYTES = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())

SPAN = pa.struct([("label", pa.string()), ("kind", pa.string()), ("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, kind: string, rule: int, start: long, end: long>>"

Match = tuple[int, int, Rule]


def phrase_places(words: list[bytes], phrases: Mapping[str, str]) -> list[tuple[int, str]]:
    """The start, in words, and the label of each place where a phrase's words stand one after another."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at, counted, word = joined.find(needle), 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            found.append((word, label))
            at = joined.find(needle, at + 1)
    return found


def unsuppressed(matches: list[Match]) -> list[Match]:
    """The matches that no other one of a higher priority, or of the same and longer or earlier, contains."""
    kept: list[Match] = []
    starts: list[int] = []
    reach: list[int] = []  # the furthest end of the stronger matches up to each start
    for priority in sorted({m[2].priority for m in matches}, reverse=True):
        level, furthest = [], -1
        for m in sorted((m for m in matches if m[2].priority == priority), key=lambda m: (m[0], -m[1], m[2].order)):
            k = bisect_right(starts, m[0])
            if m[1] > furthest:
                furthest = m[1]
                if not (k and reach[k - 1] >= m[1]):
                    level.append(m)
        kept = sorted(kept + level, key=lambda m: (m[0], -m[1]))
        starts, reach = [m[0] for m in kept], []
        for m in kept:
            reach.append(max(m[1], reach[-1] if reach else -1))
    return kept


class Scanner:
    def __init__(self, signature_rules: list[Rule], phrases: Mapping[str, str]):
        self.phrases = dict(phrases)
        self.gate = min((w for p in self.phrases for w in p.split()), key=lambda w: -sum(w in p.split() for p in self.phrases), default="").encode()
        self.rules = [(r, re.compile(r.pattern)) for r in signature_rules]
        self.words = ahocorasick.Automaton()
        for r in signature_rules:
            for alternatives in r.keywords:
                for words in alternatives:
                    for word in words:
                        self.words.add_word(word, word)
        self.words.make_automaton()

    def matches(self, text: str) -> list[Match]:
        """All matches of the rules in a text whose A-Z are in lower case."""
        held = {word for _, word in self.words.iter(text)}
        found = []
        for rule, pattern in self.rules:
            if all(any(held.issuperset(words) for words in alternatives) for alternatives in rule.keywords):
                found += [(m.start(), m.end(), rule) for m in pattern.finditer(text)]
        return found

    def scan(self, text: str) -> tuple:
        raw = text.encode().lower()
        words = raw.translate(WORD_BYTES).split()
        # All phrases hold the gate word, or there is none.
        common = all(self.gate in p.encode().split() for p in self.phrases)
        places = [] if common and self.gate not in raw else phrase_places(words, self.phrases)
        kept = unsuppressed(self.matches(raw.decode()))
        base = {label for _, label in places}
        score = max([PHRASE_SCORE * bool(base), *(m[2].score for m in kept)])
        spans = [{"label": r.label, "kind": r.kind, "rule": r.order, "start": a, "end": b} for a, b, r in kept]
        at = [p for p, _ in places]
        return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {m[2].label for m in kept})), score, spans


def scan(docs: DataFrame, signature_rules: list[Rule] | None = None, phrases: Mapping[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the words, the places of the base phrases, the labels, a score, and the rules' spans.

    ``spans`` are in characters of the text; the columns are those of ``SCHEMA``.
    """
    chosen = rules() if signature_rules is None else signature_rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Scanner(chosen, phrases)
        for batch in pieces(batches):
            rows = [one.scan(text.as_py() or "") for text in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(FIELDS) - 1)
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, FIELDS[1:], strict=True))], [n for n, _ in FIELDS])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, SCHEMA)
