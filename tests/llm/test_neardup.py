import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sigmill.llm import neardup

from .helpers import ODD, docs

WORDS = [f"w{k}" for k in range(400)]


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t))
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def fixture(n=420, seed=2):
    rng = random.Random(seed)
    common = [rng.choice(WORDS) for _ in range(25)]
    hot = [rng.choice(WORDS) for _ in range(120)]
    rows, made = [], []
    for k in range(n):
        kind = rng.random()
        if kind < 0.35:
            words = changed(rng, hot, rng.randrange(0, 6))  # one large group of near copies
        elif kind < 0.5 and made:
            words = changed(rng, rng.choice(made), rng.randrange(0, 3))
        elif kind < 0.75:
            words = common + [rng.choice(WORDS) for _ in range(rng.randrange(0, 8))]  # alike, mostly not linked
        else:
            words = [rng.choice(WORDS) for _ in range(rng.randrange(1, 150))]
        made.append(words)
        text = " ".join(words)
        rows.append((k, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("seed", [2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(neardup, "NEIGHBOURS", 3)
    monkeypatch.setattr(neardup.scan_orders, "__defaults__", (85, 3))
    monkeypatch.setattr(neardup.candidates, "__defaults__", (85, 3))
    monkeypatch.setattr(neardup.crowd_of, "__defaults__", (3,))
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rows = fixture(seed=seed)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    expected = brute(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == expected
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    kept = sorted(r["doc_id"] for r in neardup.keep_one(docs(spark, rows)).collect())
    assert kept == sorted({c for _, c in expected.values()})


def test_odd_rows(spark):
    rows = neardup.near_duplicates(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert [by[k]["n_shingles"] for k in (1, 2, 3, 4, 5, 6)] == [0, 0, 0, 1, 3, 1]
    assert by[8]["component_id"] == 5 and not by[8]["kept"] and by[5]["kept"]
    assert all(by[k]["component_id"] == k for k in (1, 2, 3, 4, 6, 7))
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.keep_one(docs(spark, ODD)).count() == len(ODD) - 1


def test_one_id_on_different_texts(spark):
    rng = random.Random(5)
    a, b, c = ([rng.choice(WORDS) for _ in range(60)] for _ in range(3))
    text = " ".join
    rows = [(7, text(a)), (7, text(b)), (9, text([*a[:-1], "other"])), (3, text([*b[:-1], "other"])), (9, text(c)), (11, text(c)), (7, text(a))]
    expected = sorted([(7, 56, 7), (7, 56, 7), (9, 56, 7), (7, 56, 3), (3, 56, 3), (9, 56, 9), (11, 56, 9)])
    for partitions in (1, 5):
        got = neardup.near_duplicates(docs(spark, rows).repartition(partitions)).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs(spark, rows)).collect()) == [3, 7, 7, 7, 9, 9]


def test_region_of_boilerplate(spark, monkeypatch):
    """Texts that share most of their words, so that one region holds all of them, and few links among them."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(6)
    shared = [rng.choice(WORDS) for _ in range(120)]
    rows = [(k, " ".join(shared + [rng.choice(WORDS) for _ in range(rng.choice([0, 12, 30, 34]))])) for k in range(160)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows) and 2 < len({c for _, c in got.values()}) < 160


def test_empty(spark):
    assert neardup.near_duplicates(docs(spark, [])).collect() == []
    assert neardup.keep_one(docs(spark, [])).collect() == []


def test_word_hashes_do_not_cross_texts():
    texts = pa.array(["a b c", "", "a b c d e f", "A\tB\nc", "f"])
    hashes, at = neardup.shingle_sets(texts)
    sets = [set(hashes[lo:hi].tolist()) for lo, hi in zip(at[:-1], at[1:])]
    assert [len(s) for s in sets] == [1, 0, 2, 1, 1] and sets[0] == sets[3] and not sets[0] & sets[2]


def test_agreement_counts_fields():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 16, (50, 128), dtype=np.uint8), rng.integers(0, 3, (50, 128), dtype=np.uint8)
    pack = lambda x: np.ascontiguousarray(x[:, ::2] << 4 | x[:, 1::2]).view(np.uint64)
    assert neardup.agreement(pack(a), pack(b)).tolist() == (a == b).sum(axis=1).tolist()


@pytest.mark.parametrize("block", [20, 1000])
def test_components_of_chains_and_stars(spark, block):
    rng = random.Random(1)
    nodes = list(range(300))
    rng.shuffle(nodes)
    edges = list(zip(nodes[:100], nodes[1:101])) + [(nodes[150], n) for n in nodes[151:250]] + [(5, 5)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long").repartition(16), block).collect()}
    for part in (nodes[:101], nodes[150:250]):
        assert all(got.get(n, n) == min(part) for n in part)
