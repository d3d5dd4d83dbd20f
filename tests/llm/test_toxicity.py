import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sigmill.llm import toxicity as t

from .helpers import ODD, docs

BAD = ["villain", "rotten", "swine"]


def test_fold():
    assert t.fold("V1LLAIN") == " villain " and t.fold("v!llain") == " villain " and t.fold("vіllаіn") == " villain "  # the last with Cyrillic letters
    assert t.fold("vil​lain") == " villain " and t.fold("ｖｉｌｌａｉｎ") == " villain " and t.fold("$wine, ROTTEN$$$ !") == " swine rotten "
    assert t.fold("12 30") == "  " and t.fold("") == "  " and t.fold("réeux") == " réeux "


def test_longest_pattern_and_exceptions():
    lexicon = t.Lexicon({" rott": 1.0, " rotten ": 3.0, " swin": 2.0}, [" swinging ", " rotten luck "])
    assert sorted(w for _, w in lexicon.hits(t.fold("rotten rotting swinging swinery"))) == [1.0, 2.0, 3.0]
    assert lexicon.hits(t.fold("rotten luck")) == [] and len(lexicon.hits(t.fold("rotten lucky"))) == 1
    assert t.Lexicon({}, []).hits(" a ") == []


def naive_hits(lexicon, folded):
    """The longest pattern at each blank, by comparing every pattern, without those that lie within an exception."""
    cover = [(k, k + len(e) - 1) for e in lexicon.exceptions for k in range(len(folded)) if folded.startswith(e, k)]
    out = []
    for k in range(len(folded)):
        found = [p for p in lexicon.weights if folded.startswith(p, k)]
        if found:
            p = max(found, key=len)
            if not any(lo <= k and k + len(p) - 1 <= hi for lo, hi in cover):
                out.append((k, lexicon.weights[p]))
    return out


@given(st.lists(st.sampled_from(["ab", "abc", "abcd", "b", "bc", "ca", "cab"]), max_size=14), st.sets(st.sampled_from([" ab", " ab ", " abc", " abcd ", " b", " ca ", " cab", " ab b"])), st.sets(st.sampled_from([" ab b ", " abc ", " b bc ca ", " ca ab ", " bc b ab "])))
@settings(max_examples=400, deadline=None)
def test_automaton_against_comparing_every_pattern(words, patterns, exceptions):
    lexicon = t.Lexicon({p: float(k + 1) for k, p in enumerate(sorted(patterns))}, sorted(exceptions))
    folded = t.fold(" ".join(words))
    assert lexicon.hits(folded) == naive_hits(lexicon, folded)


def test_phrases_hold_the_word():
    assert t.phrases_of(" a b c d ", {4}) == {" c ", " b c ", " c d ", " a b c ", " b c d "}
    assert t.phrases_of(" a ", {0}) == {" a "} and t.phrases_of(" a b ", set()) == set()


def test_phrases_usual_in_clean_texts_are_exceptions(spark):
    rows, labels = corpus(1500)
    rng = random.Random(3)
    rows = [(i, f"{x} the killer" if y else f"{x} killer whale" if rng.random() < 0.02 else x) for (i, x), (_, _, y) in zip(rows, labels)]
    lexicon = t.learn(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert " killer " in lexicon.weights and " killer whale " in lexicon.exceptions and " the killer " not in lexicon.exceptions
    assert lexicon.hits(t.fold("Killer whale")) == [] and len(lexicon.hits(t.fold("k1ller"))) == 1


def corpus(n=1200):
    rng = random.Random(0)
    plain = [f"plain{a}{b}" for a in "abcdefgh" for b in "qrstuvwxyz"] + ["swinging"]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 40))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice([*BAD, "swineherd", "swinery"]) if rng.random() < 0.8 else "v1llain")
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_held_out(spark):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: x for i, _, x in labels}
    got = t.classify(docs(spark, rows), table).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) and len(held) > 200
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_odd_rows(spark):
    rows, labels = corpus(600)
    table = spark.createDataFrame([*labels, (5, 1, 1), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = t.classify(docs(spark, [*rows, *[(i if i is None else i + 10_000, x) for i, x in ODD]]), table).collect()
    odd = {r["doc_id"]: r for r in got if r["doc_id"] is None or r["doc_id"] > 9_999}
    assert len(got) == len(rows) + len(ODD) and odd[10_001]["score"] == odd[10_002]["score"] and all(0 <= r["score"] <= 1 for r in got)


def test_without_labels_and_empty(spark):
    table = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in t.classify(docs(spark, ODD), table).collect()} == {0}
    assert t.classify(docs(spark, []), table).collect() == []
    lexicon = t.learn(docs(spark, corpus(600)[0]), spark.createDataFrame(corpus(600)[1], "doc_id long, quality int, toxic int"))
    kept = t.reject(docs(spark, [(1, "a rotten villain"), (2, "plainaq"), (3, None)]), lexicon)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3] and kept.columns == docs(spark, []).columns
