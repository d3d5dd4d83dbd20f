import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sigmill.llm import langid

from .helpers import ODD, docs

SYLLABLES = {"en": ["th", "ing", "the", "on"], "de": ["sch", "ung", "ein", "ich"], "fr": ["eau", "ment", "é", "oi"], "es": ["ción", "mente", "ñ", "os"], "xx": ["qq", "zz", "kk", "vv"]}


def corpus(n=400):
    rng = np.random.default_rng(0)
    langs = list(SYLLABLES)
    return [(k, " ".join("".join(rng.choice(SYLLABLES[langs[k % 5]], size=int(rng.integers(1, 4)))) for _ in range(int(rng.integers(4, 60)))), langs[k % 5]) for k in range(n)]


def test_held_out_accuracy(spark):
    rows = corpus()
    truth = {i: lang for i, _, lang in rows}
    got = langid.classify(docs(spark, rows)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) and len(held) > 50
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    model = langid.learn(docs(spark, corpus()))
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, [*ODD, (20, "123 !? …"), (21, "漢字")]).select("doc_id", "text"), model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 20)] == ["und"] * 4 and got[1]["score"] == 0
    assert all(got[k]["lang_pred"] in SYLLABLES for k in (4, 5, 6, 7, 21, None))
    kept = langid.reject(docs(spark, [*ODD, (20, "123")]), model, bar=0.0)
    assert {1, 2, 3, 20} & {r["doc_id"] for r in kept.collect()} == set() and kept.count() == len(ODD) - 3


def test_without_training_rows_and_empty(spark):
    got = langid.classify(docs(spark, ODD)).collect()  # no row has a lang
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got} == {"und"}
    assert langid.classify(docs(spark, [])).collect() == []
    one = langid.classify(docs(spark, [(k, "some text here", "en") for k in range(20)])).collect()
    assert {r["lang_pred"] for r in one} == {"en"}


def test_inputs_are_the_text_alone(spark):
    rows = corpus(100)
    model = langid.learn(docs(spark, rows))
    a = langid.identify(docs(spark, rows), model).select("doc_id", "lang_pred", F.round("score", 9)).collect()
    b = langid.identify(docs(spark, [(i, t, "none") for i, t, _ in rows]), model).select("doc_id", "lang_pred", F.round("score", 9)).collect()
    assert sorted(a) == sorted(b)


def test_copies_do_not_thin_the_sample(spark, monkeypatch):
    rows = corpus()
    copies = [(1000 + k, "the same text in many copies", "en") for k in range(8000)]
    monkeypatch.setattr(langid, "Model", lambda langs, design, y: y.tolist())
    alone, among = (langid.learn(docs(spark, r), train_rows=40) for r in (rows, rows + copies))  # 80 distinct texts a language
    assert 20 <= alone.count("en") and 20 <= among.count("en") <= 60
    assert all(alone.count(lang) == among.count(lang) for lang in SYLLABLES if lang != "en")


def test_counts_and_margins_against_plain_loops(spark):
    """Trigrams of one text after another, in Python, and margins from them."""
    texts = ["Straße und Haus", "a b", "ñandú ñandú!", "", "x1y2z3", "漢字 mixed TEXT"]

    def plain(text):
        raw = [ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else b if b >= 128 else 32 for b in text.encode()]
        out = {}
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            if b != 32:
                h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
                h ^= h >> 15
                g = (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 20
                out[g] = out.get(g, 0) + 1
        return out

    rows = langid.counted(docs(spark, [(k, t, str(k)) for k, t in enumerate(texts)])).collect()
    got = {int(r["lang"]): dict(zip(np.frombuffer(r["columns"], "<u2").tolist(), np.frombuffer(r["counts"], "<u4").tolist())) for r in rows}
    assert got == {k: plain(t) for k, t in enumerate(texts)}
    model = langid.learn(docs(spark, corpus()))
    for text in texts[:3]:
        own = plain(text)
        margins = np.array([[sum(n * w[g] for g, n in own.items()) / max(1, sum(own.values())) * langid.SCALE + w[-1] for w in model.machines.astype(float)]])
        best, sure = model.decide(margins)
        found = langid.identify(docs(spark, [(1, text)]), model).first()
        assert found["lang_pred"] == model.langs[best[0]] and abs(found["score"] - sure[0]) < 1e-6


def test_a_spoiled_lang_column(spark):
    rows = [*corpus(200), *[(1000 + k, f"text of its own {k}", f"junk{k}") for k in range(60)]]
    model = langid.learn(docs(spark, rows), most_langs=5)
    assert set(model.langs) == set(SYLLABLES)


def test_trigrams_stay_within_texts():
    from sigmill.llm.common import utf8_block

    raw, at = utf8_block(pa.array(["ab", "cde", "", "x"]))
    _, use = langid.trigrams(raw, at)
    assert use.tolist() == [False, False, True, False, False, False]
