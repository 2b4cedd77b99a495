"""The pipeline against its stages done by hand, one on what the other kept."""

import hashlib
import math
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline
from lamella.llm import quality
from test_line_dedup import by_hand as lines_by_hand
from test_mixing import by_hand as mix_by_hand
from test_near_dedup import by_hand as near_by_hand
from test_quality import scores_by_hand


def tables(folder, spark):
    chance = random.Random(12)
    bits = ["the ", "of a ", "ha", "Tion", "er", ". ", "sh", "and "]
    line = lambda: "".join(chance.choice(bits) for _ in range(chance.randint(6, 20))).strip()
    docs = []
    for k in range(120):
        if k % 9 == 8:
            text = "".join(chance.choice("$%&#XQZ*~!") for _ in range(80))
        elif k % 5 == 4 and docs:
            text = chance.choice([d[1] for d in docs if d[1]])
            if chance.random() < 0.5:
                text = "\n".join(t + chance.choice(["", "x"]) for t in text.split("\n"))
        else:
            text = "\n".join(line() for _ in range(chance.randint(1, 6)))
        docs.append((k, text, ["en", "de"][k % 2], f"s{k % 4}", len(text)))
    long = " ".join(line() for _ in range(20))
    docs += [(200, long, "en", "s1", len(long)), (201, f"{long} the ertion", "en", "s2", len(long) + 11), (202, None, None, None, None), (203, "", "en", None, 0), (None, "the of a ertion", None, "s0", 15)]
    labels = [(k, int(not set(docs[k][1]) <= set("$%&#XQZ*~!x\n")), 0) for k in range(0, 120, 2)]  # some are copies of junk
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, labels


def accepted_by_hand(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    score = list(scores_by_hand([t for _, t, *_ in docs], [t for i, t, *_ in docs if i in good and t]))
    limit = lambda x: (math.floor(sorted(x)[math.ceil(quality.TAIL * len(x)) - 1] / quality.BIN + 1e-9) + 1) * quality.BIN
    own = defaultdict(list)
    for k, (i, _, lang, *_) in enumerate(docs):
        if i in good:
            own[lang].append(score[k])
    every = limit([x for v in own.values() for x in v])
    limits = {lang: limit(v) for lang, v in own.items() if len(v) >= quality.FEW}
    return [d for k, d in enumerate(docs) if score[k] is None or score[k] <= limits.get(d[2], every)]


def test_as_the_stages_by_hand(spark, tmp_path):
    docs, labels = tables(str(tmp_path), spark)
    kept = accepted_by_hand(docs, labels)
    assert 5 < len(docs) - len(kept) < 20
    texts = {i: t for i, t, *_ in lines_by_hand([(i, t) for i, t, *_ in kept])}
    blank = lambda t: not re.sub(r"[ \t\r\n]", "", t or "")
    kept = [(i, texts[i], *rest) for i, t, *rest in kept if blank(t) or not blank(texts[i])]
    stays = {i: i == c for i, _, c in near_by_hand([(i, t) for i, t, *_ in kept], 5, 80)}
    assert sum(not x for x in stays.values())
    kept = [d for d in kept if stays[d[0]]]
    mixed = mix_by_hand([(i, t, s) for i, t, _, s, _ in kept])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for (i, t, *_), (_, size, _, _, taken) in zip(kept, mixed):
        for _ in range(taken // size if size else 0):
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    out = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(out, key=repr) == sorted(expected, key=repr)


#: Names that operators and stages use for themselves, and others that need care.
NAMES = [
    "a.b", "k`y", "row", "doc", "text_key", "key", "copies", "alike", "own", "turn", "gone", "had", "g_doc", "g_key", "g_lang", "stays", "first_key", "m_doc", "m_key", "kept", "near",
    "__id", "__key", "__gone", "__own", "__doc", "__language", "__copies", "__rows", "__had", "__first", "TEXT2", "group_id", "line", "lines", "id", "size", "n_lines", "fold", "bucket", "place",
]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns_and_take_nothing(spark, tmp_path, name, stage):
    tables(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.select("*", *(F.concat_ws("-", F.lit(k), "doc_id").alias(n) for k, n in enumerate(NAMES)))
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[5 + k] == f"{k}-{'' if r.doc_id is None else r.doc_id}".removesuffix("-" if r.doc_id is None else "") for r in rows for k in range(len(NAMES)))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark, tmp_path):
    """Lines and near-copies: nothing goes but what the row itself has in common with an earlier one."""
    one, two = " ".join(f"w{k}" for k in range(30)), " ".join(f"v{k}" for k in range(30))
    rows = [(1, one), (1, two), (1, one), (2, one + " end"), (3, two), (None, one), (None, two), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, corpus_pipeline.keep_distinct(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(1, one), (1, two), (None, one), (None, two), (4, None), (5, "")], key=repr)
    lines = spark.createDataFrame([(1, "a line that repeats\nits own line, first"), (1, "its own line, second\na line that repeats"), (None, "a line that repeats\nits own line, third")], "doc_id long, text string")
    out = sorted((r.text for r in corpus_pipeline.drop_lines(spark, lines, "").collect()))
    assert sum("a line that repeats" in t for t in out) == 1 and all(any(w in t for t in out) for w in ("first", "second", "third"))


def test_order_of_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None
