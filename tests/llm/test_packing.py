import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigmill.llm import packing

from .helpers import ODD, docs

path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def naive(lengths, capacity):
    """Best-fit decreasing, piece by piece: the rooms left, sorted."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=300, deadline=None)
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    used, seen = {}, {}
    for length, lo, hi, first, per, offset in packing.best_fit(counts, 40).tolist():
        for rank in range(lo, hi):
            bin_, at = first + (rank - lo) // per, offset + (rank - lo) % per * length
            assert (length, rank) not in seen
            seen[length, rank] = bin_
            used.setdefault(bin_, []).append((at, length))
    assert len(seen) == len(lengths) and sorted(used) == list(range(len(used)))
    rooms = []
    for spans in used.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 40
        rooms.append(40 - end)
    assert sorted(rooms) == naive(lengths, 40)


def test_tree_finds_the_least():
    rng, tree, has = random.Random(0), packing.Tree(100), set()
    for _ in range(2000):
        at = rng.randrange(0, 101)
        tree.mark(at, at not in has)
        has ^= {at}
        bound = rng.randrange(0, 101)
        assert tree.least(bound) == min((x for x in has if x >= bound), default=None)


def check(rows, texts, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], {})[r["piece"]] = r
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        parts = [(k, ids[k : k + capacity]) for k in range(0, len(ids), capacity)]
        assert [(by[i][p]["start"], by[i][p]["length"], by[i][p]["ids_crc32"]) for p in range(len(parts))] == [(k, len(x), zlib.crc32(x.tobytes())) for k, x in parts]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= capacity
    return len(bins)


def test_documents(spark):
    rng = random.Random(1)
    texts = {k: " ".join(rng.choice(["The", "cat's", "don't", "naïve", "3,000", "x.y.", "end.", "é́", "áb", "ΑΣ", "<|endoftext|>", "a\x1cb", "q\x0bz", "Hello,"]) for _ in range(rng.randrange(0, 90))) for k in range(120)}
    rows = packing.pack(docs(spark, texts.items()), path, capacity=64).collect()
    bins = check(rows, texts, 64)
    assert bins == len(naive([r["length"] for r in rows], 64))


def test_odd_rows_and_empty(spark):
    rows = packing.pack(docs(spark, ODD), path).collect()
    texts = {i: t for i, t in ODD}
    check(rows, {i: t for i, t in texts.items() if i != 5}, 4096)
    five = [r for r in rows if r["doc_id"] == 5]
    assert len(five) == 2 and five[0]["ids_crc32"] == five[1]["ids_crc32"]
    assert next(r for r in rows if r["doc_id"] == 1)["length"] == 1
    assert packing.pack(docs(spark, []), path).collect() == []


def test_cache_is_bounded_and_keeps_frequent_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    words = packing.words_for(path)
    words.clear()
    fresh = packing.words_for(path).__class__(words.encode)
    for k in range(30):
        texts = pa.array([f"the same few words, {' '.join(f'new{k}x{j}.' for j in range(9))}", ""])
        ids, at = words.ids(texts)
        monkeypatch.setattr(packing, "CACHED_WORDS", 10**6)
        expected, offsets = fresh.ids(texts)
        monkeypatch.setattr(packing, "CACHED_WORDS", 40)
        assert ids.tolist() == expected.tolist() and at.tolist() == offsets.tolist()
        assert len(words.known) <= 40 + 14 and list(words.known)[:3] == list(words.ENDS)
    assert {"the", "same", "few"} <= set(words.known) and "new0x1" not in words.known
    words.clear()


def test_one_length_in_all_rows(spark):
    rows = packing.pack(docs(spark, [(k % 3, "one two three") for k in range(400)]).repartition(7), path, capacity=10).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == 400 and {r["length"] for r in rows} == {4} and len({s for s, _ in places}) == 200


def test_ids_are_kept_on_demand(spark):
    rows = packing.pieces(docs(spark, [(1, "hello world")]), path, with_ids=True).collect()
    assert rows[0]["ids"][-1] == 1 and len(rows[0]["ids"]) == rows[0]["length"]


ENDINGS = ["", ".", ",", "###", "$$$", ",%%%", ".***", "!!", "&&&", "_", "...)", "--", "'", "'s", "'s.", "'.", "|.", ".|", ">", "÷.", "é.", "\u0301.", "2.", "²!"]


def test_words_with_any_ending_are_encoded_as_by_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(path), packing.words_for(path)
    rng = random.Random(3)
    stems = ["the", "don't", "straße", "ÉCOLE", "ñandú", "İ", "ﬁn", "x.y", "3", "ΑΣ", "a|", "漢字", "'", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|EndOfText|>y", "<|startoftext|>"]
    stems += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzßàáäçèéêíñóöøúüÿ") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    texts = [f"{a}{e} {a.upper()}{e}\t{e} " for a in stems for e in ENDINGS]
    for some in [texts, *([one] for one in texts[: 18 * len(ENDINGS)])]:  # together, and each as a block of its own
        words.clear()
        ids, at = words.ids(pa.array(some))
        for k, text in enumerate(some):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    words.clear()


def test_one_word_with_many_endings_is_encoded_once():
    import pyarrow as pa

    sent = []

    def encode(texts):
        sent.extend(w for t in texts for w in t.split(" ") if w != packing.MARK)
        return whole(texts)

    whole = packing.words_for(path).encode
    words = packing.Words(encode)
    stems, ends = [f"stem{chr(97 + k)}" for k in range(20)], ["", ".", "###", "$$$", ",%%%", ".***", "!!", "&&&"]
    words.ids(pa.array([" ".join(a + e for e in ends) for a in stems]))
    assert sorted(x for x in sent if x.startswith("stem")) == stems


def test_quick_ways_give_the_ids_of_the_whole_tokenizer():
    words, rng = packing.words_for(path), random.Random(4)
    letters = {0: "abcdefghijklmnopqrstuvwxyz", 1: "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))}
    for k, some in letters.items():
        _, quick, sign, mark = words.ways[k]
        assert mark is not None
        sample = [*some, *("".join(rng.choice(some) for _ in range(rng.randrange(1, 30))) for _ in range(3000))]
        flat, lengths = words.joined(sample, quick, sign, mark)
        each = words.encode(sample)
        assert flat.tolist() == [x for one in each for x in one] and lengths.tolist() == [len(one) for one in each]
