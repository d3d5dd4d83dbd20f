import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sigmill.llm import lm
from sigmill.llm.common import crc_mod

from .helpers import ODD, docs


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def corpus(n=300):
    rng = np.random.default_rng(5)
    kinds = [["red", "green", "blue", "is", "a", "colour"], ["eins", "zwei", "drei", "ist", "eine", "zahl"]]
    return [(k, " ".join(rng.choice(kinds[k % 2], size=int(rng.integers(3, 40)))) + f" only{k}") for k in range(n)]


def score(spark, rows):
    return lm.score_documents(docs(spark, rows), crc_mod(F.col("doc_id"), 10) == 0).collect()


def test_counts_and_base_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 40)  # so that some words are joined
    rows = [*corpus(), *ODD]
    got = score(spark, rows)
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t if i not in texts else texts[i])
    for r in got:
        if r["doc_id"] == 5 or r["doc_id"] is not None and r["doc_id"] < 10:
            continue  # ids that both tables have
        own = words(texts[r["doc_id"]])
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(counts[w] > 0 for w in own)
        assert r["train_tokens"] == total and r["held_out"] == held(r["doc_id"])
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9


def test_model_beats_base_on_held_out(spark):
    got = [r for r in score(spark, corpus(600)) if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) * 0.97


def test_probabilities_sum_to_one(spark):
    rows = corpus(80)
    counts = lm.counts_of(docs(spark, rows)).persist()
    vocab = lm.vocabulary(counts)
    model = lm.trained(docs(spark, rows), vocab)
    first, second, normaliser = (x.astype(float) for x in model.tables())
    for c1, c2 in ((0, 0), (3, 700), (lm.CONTEXTS - 1, lm.CONTEXTS - 1)):
        assert abs((10 ** (first[c1] + second[c2] - normaliser[c1, c2])).sum() - 1) < 1e-4
    # shares of the words of one bucket, with one for unknown words
    every = counts.toArrow().combine_chunks()
    _, out, _ = vocab.classes(every["word"].combine_chunks())
    number = every["n"].to_numpy()
    for bucket in range(lm.BUCKETS):
        own = number[out == vocab.outputs + bucket]
        whole = vocab.bucket_n[bucket] + lm.SMOOTH * (vocab.bucket_v[bucket] + 1)
        assert abs((own + lm.SMOOTH).sum() + lm.SMOOTH - whole) < 1e-9


def test_hot_words_are_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 5)
    counts = spark.createDataFrame([(f"w{k}", n) for k, n in enumerate([9, 8, 8, 7, 3, 3, 3, 1])], "word string, n long")
    vocab = lm.vocabulary(counts)
    assert vocab.words.to_pylist() == ["w0", "w1", "w2", "w3"] and (vocab.total, vocab.distinct) == (42, 8)
    assert vocab.bucket_n.sum() == 10 and vocab.bucket_v.sum() == 4


def test_tokens_of_blocks():
    vocab = lm.Vocabulary(pa.array(["", "a"]), np.array([3, 2]), 5, 2, np.zeros(lm.BUCKETS), np.zeros(lm.BUCKETS))
    t = lm.tokens_of(pa.array(["A b", "", "b"]), vocab)
    start = lm.CONTEXTS - 1
    assert t.at.tolist() == [0, 3, 4, 6] and t.out[[0, 2, 3]].tolist() == [1, 0, 0]
    assert t.c1[[0, 3, 4]].tolist() == [start] * 3 and t.c2[[0, 1, 3, 4, 5]].tolist() == [start] * 5 and t.c1[1] == 1


def test_empty_and_untrained(spark):
    assert score(spark, []) == []
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:3]
    got = score(spark, [(held[0], "some words"), (held[1], None), (held[2], "")])
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}
    assert all(math.isfinite(r["score"]) for r in got)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words, size=int(rng.integers(3, 40)), p=np.arange(60, 0, -1) / 1830))) for k in range(500)] + [(None, None), (3, "w1 w2"), (3, "w1 w2")]
    found = []
    for parts in (1, 7):
        df = docs(spark, rows).repartition(parts)
        got = lm.score_documents(df, F.col("doc_id") % 10 == 0).collect()
        found.append(sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["score"]) for r in got))
    assert len(found[0]) == len(rows)
    for a, b in zip(*found):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) <= 1e-6 * max(1.0, abs(a[4]))
