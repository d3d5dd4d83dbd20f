import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sigmill.llm import decontamination as d

from .helpers import ODD, docs

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def least_edits(item, text):
    """Sellers' algorithm: fewest edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcxyz")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("abcxyz"))
    return "".join(out)


def clean(text):
    return " ".join(text.lower().split())


@given(st.text("ab", min_size=1, max_size=14), st.text("ab", max_size=24), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_align_finds_the_fewest_edits(item, text, edits):
    found = d.align(*(np.array([ord(c) for c in x], np.uint32) for x in (item, text)), edits)
    best = least_edits(item, text)
    assert (found is None) == (best > edits)
    if found:
        assert found[0] == best and least_edits(item, text[found[1] : found[2]]) == best


def test_planted_items_against_brute_force(spark):
    rng = random.Random(3)
    items = [(k, prose(rng, n)) for k, n in enumerate([4, 8, 12, 20, 40, 60])] + [(50, "tiny"), (51, ""), (52, None), (None, "x"), (0, "")]
    rows = []
    for k in range(160):
        text = prose(rng, rng.randrange(5, 60))
        if k % 2:
            item = rng.choice(items[:6])[1]
            text = f"{text} {edited(rng, item, rng.randrange(0, max(1, int(0.11 * len(item)))))} {prose(rng, 10)}"
        if k % 5 == 0:
            text = text.upper().replace(" ", " \n ")
        rows.append((k, text))
    df = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, start string")
    got = {(r["doc_id"], r["item_id"]): r for r in d.contamination(docs(spark, rows), df).collect()}
    expected = {}
    for i, text in rows:
        for j, item in items:
            if item and j is not None:
                budget, best = int(d.EDIT_RATE * len(clean(item))), least_edits(clean(item), clean(text))
                if best <= budget:
                    expected[i, j] = best
    assert {k: r["edits"] for k, r in got.items()} == expected
    texts, bench = dict(rows), dict((j, t) for j, t in items if t)
    for (i, j), r in got.items():
        assert least_edits(clean(bench[j]), clean(texts[i][r["start"] : r["end"]])) == r["edits"]
    kept = {r["doc_id"] for r in d.decontaminate(docs(spark, rows), df).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in expected}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, prose(rng, 15)) for k in range(12)]
    rows = [(k, prose(rng, 5) + " " + items[k % 12][1] + " " + prose(rng, 5)) for k in range(24)]
    df = spark.createDataFrame(items, "item_id int, text string")
    whole = sorted(map(tuple, d.contamination(docs(spark, rows), df).collect()))
    kept = sorted(r["doc_id"] for r in d.decontaminate(docs(spark, [*rows, (99, "alpha")]), df).collect())
    monkeypatch.setattr(d.item_blocks, "__defaults__", (200,))
    found = d.contamination(docs(spark, rows).repartition(3), df)
    assert sorted(map(tuple, found.collect())) == whole and len(whole) >= 24
    left = d.decontaminate(docs(spark, [*rows, (99, "alpha")]), df)
    assert sorted(r["doc_id"] for r in left.collect()) == kept == [99]
    for frame in (found, left):  # one pass over the documents for all blocks
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([(1.5, "three four five six")], "item_id double, text string")
    rows = spark.createDataFrame([("a", "one two three four five six"), ("b", "one")], "doc_id string, text string")
    assert [(r["doc_id"], r["item_id"]) for r in d.contamination(rows, df).collect()] == [("a", 1.5)]


def test_odd_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "three four five six"), (2, None)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in d.contamination(docs(spark, ODD), df).collect()) == [(5, 1), (5, 1), (8, 1)]
    assert d.decontaminate(docs(spark, ODD), df).count() == len(ODD) - 3
    assert d.contamination(docs(spark, []), df).collect() == [] and d.contamination(docs(spark, ODD), df.limit(0)).collect() == []
    assert d.decontaminate(docs(spark, ODD), df.limit(0)).count() == len(ODD)
