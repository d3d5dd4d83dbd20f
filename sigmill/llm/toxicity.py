"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lowers case and maps homoglyphs, digits and signs that stand for letters; all that is no letter becomes one
blank. The lexicon holds whole words and beginnings of words with weights learned from labelled rows: the log of how
much more often toxic texts have them. Exceptions are phrases of one to three words that hold a listed word or beginning but are
usual in clean texts; nothing counts inside them. All patterns that labelled rows support are listed, however many.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_blocks

# Letters of other scripts that look like Latin ones; digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i"}

TRAIN_ROWS = 20_000  # labelled rows that the lexicon and its calibration are learned from, at most
LEAST_DOCS, LEAST_WEIGHT = 5, 2.0  # a listed pattern has at least this weight and this many toxic texts
SHORTEST, LONGEST = 4, 8  # letters of the beginnings of words; a whole word is listed at any length
PHRASE = 3  # words of an exception, at most

_LETTERS = str.maketrans(HOMOGLYPHS)
_SIGN = re.compile(r"(?:(?<=[^\W\d_])|(?<![^\s]))[@$!](?=[^\W\d_])")
_DIGIT = re.compile(r"[0-9](?=[^\W\d_])|(?<=[^\W\d_])[0-9]")
_REST = re.compile(r"[\W\d_]+")
_ZERO_WIDTH = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")


def fold(text: str) -> str:
    """Folded words, one blank before, between and after them."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _ZERO_WIDTH.sub("", text)).lower().translate(_LETTERS)
    else:
        text = text.lower()
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    text = _DIGIT.sub(lambda m: DIGITS.get(m[0], " "), text)
    return f" {_REST.sub(' ', text).strip()} "


def patterns_of(folded: str) -> set[str]:
    """Whole words (` word `) and beginnings of words (` wor`) of a folded text."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for n in range(SHORTEST, LONGEST + 1):
        out |= {f" {w[:n]}" for w in words if len(w) > n}
    return out


def phrases_of(folded: str, starts: set[int]) -> set[str]:
    """The phrases of 1 to PHRASE words (` a phrase `) of a folded text that hold a word whose blank is at one of starts."""
    words, at, place = folded.split(), {}, 0
    for k, w in enumerate(words):
        at[place] = k
        place += len(w) + 1
    out = set()
    for k in (at[s] for s in starts):
        for n in range(1, PHRASE + 1):
            for first in range(max(0, k - n + 1), min(k, len(words) - n) + 1):
                out.add(f" {' '.join(words[first : first + n])} ")
    return out


class Lexicon:
    """weights: by pattern. exceptions: phrases (` a phrase `) in which no pattern counts. model: of the calibration, or None."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], model: list[float] | None = None):
        self.weights, self.exceptions, self.model = weights, exceptions, model
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of the longest pattern at each word start, in their order, outside of exception phrases."""
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for p in {*self.weights, *self.exceptions}:
                a.add_word(p, p)
            if len(a):
                a.make_automaton()
            self._automaton, self._skip = a, set(self.exceptions)
        if not len(self._automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        cover: dict[int, int] = {}  # by start the last end of a phrase
        for end, p in self._automaton.iter(folded):
            start = end - len(p) + 1
            if p in self._skip:
                cover[start] = max(cover.get(start, 0), end)
            if (w := self.weights.get(p)) is not None and (start not in best or best[start][0] < len(p)):
                best[start] = (len(p), w)
        out, covered = [], -1
        for at in sorted({*best, *cover}):
            covered = max(covered, cover.get(at, -1))
            if at in best and at + best[at][0] - 1 > covered:
                out.append((at, best[at][1]))
        return out

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Largest weight, logarithm of the sum, sum by the logarithm of the length, sum by length in words."""
        folded = fold(text or "")
        found = [w for _, w in self.hits(folded)]
        if not found:
            return 0.0, 0.0, 0.0, 0.0
        words, total = folded.count(" ") - 1, sum(found)
        return max(found), float(np.log1p(total)), total / np.log2(2 + words), 100 * total / (words + 20)

    def all_features(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows of features of a batch's texts."""
        rows = [self.features(t) for _, _, texts in text_blocks(batch) for t in texts.to_pylist()]
        return np.array(rows, dtype=np.float64).reshape(-1, 4)

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1 for rows of features."""
        weights = np.asarray(self.model)
        return 1 / (1 + np.exp(-np.clip(features @ weights[1:] + weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> list[float]:
    """Weights (constant first) of a ridge logistic regression by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    keep = ridge * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + keep, design.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def feature_rows(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs (doc_id, text, ...) without the text, with the features f0 to f3."""
    names = [c for c in docs.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = lexicon.all_features(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(f[:, k]) for k in range(4)]], names=[*names, "f0", "f1", "f2", "f3"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(score, f"{schema}, f0 double, f1 double, f2 double, f3 double")


def counts_of(rows: DataFrame, found_in: Callable[[str], set[str]]) -> DataFrame:
    """(pattern, t, n): how many toxic and how many other texts of rows (text, toxic) each pattern is found in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for row, n, texts in text_blocks(batch):
                for text, toxic in zip(texts.to_pylist(), batch.column("toxic").slice(row, n).to_pylist()):
                    for p in found_in(fold(text)):
                        found.setdefault(p, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64())], names=["pattern", "t", "n"])

    return rows.select("text", "toxic").mapInArrow(count, "pattern string, t long, n long").groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """The lexicon from labelled rows (labels: doc_id, toxic 0 or 1) among docs, train_rows at most, in the order of a hash.

    Equal texts count once. Half of the rows give the weights and exceptions, the others the calibration. Without rows of
    both labels the lexicon is empty and every score the share of toxic rows (0 if there are none).
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most train_rows rows
    part = F.pmod(F.xxhash64(F.col("text")), F.lit(2))
    unique = rows.where("text is not null").groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("part", part).cache()
    try:
        sizes = {(r["part"], r["toxic"]): r["n"] for r in unique.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        toxic, clean = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
        share = sum(n for (_, t), n in sizes.items() if t) / max(1, sum(sizes.values()))
        lexicon = Lexicon({}, [])
        if toxic and clean:
            half = unique.where("part = 0")
            weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
            listed = counts_of(half, patterns_of).where(F.col("t") >= LEAST_DOCS).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT)
            lexicon = Lexicon({r["pattern"]: float(r["w"]) for r in listed.collect()}, [])  # of train_rows texts at most
            if lexicon.weights:
                held = counts_of(half, lambda folded: phrases_of(folded, {at for at, _ in lexicon.hits(folded)}))
                usual = held.where(F.col("n") >= LEAST_DOCS).withColumn("w", weight).where(F.col("w") < LEAST_WEIGHT / 2)
                lexicon = Lexicon(lexicon.weights, sorted(r["pattern"] for r in usual.collect()))
        if lexicon.weights:
            sample = feature_rows(unique.where("part = 1").select("text", "toxic"), lexicon).select("toxic", "f0", "f1", "f2", "f3").toPandas()  # train_rows rows at most
            if sample["toxic"].nunique() == 2:
                lexicon.model = logistic(sample[["f0", "f1", "f2", "f3"]].to_numpy(), sample["toxic"].to_numpy(dtype=float))
        if lexicon.model is None:
            lexicon.model = [float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), 0.0, 0.0, 0.0, 0.0]
    finally:
        unique.unpersist()
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs without the text, with score in place of any column of that name; a null or empty text has the score of a text without a hit. Repeated rows are repeated."""

    def probability(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = lexicon.all_features(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(lexicon.score(f))], names=[*names, "score"])

    docs = docs.drop("score")
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(probability, f"{schema}, score double")


def reject(docs: DataFrame, lexicon: Lexicon, bar: float = 0.3) -> DataFrame:
    """docs, with all their columns, without the rows that score `bar` or more.

    A null or empty text scores like a text without a hit; repeated rows share one verdict; an empty table stays empty.
    """

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = lexicon.all_features(batch)
            yield batch.filter(pa.array(lexicon.score(f) < bar))

    return docs.mapInArrow(drop, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, held: int = 2, folds: int = 4, bar: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs: learned from rows whose crc32(doc_id as text) mod folds is not `held`.

    Null and empty texts have the score of a text without a hit; a null doc_id counts as the empty text in the fold; repeated
    rows are repeated, extra columns ignored, and an empty table gives one.
    """
    fold_of = crc_mod(F.col("doc_id"), folds)
    lexicon = learn(docs.select("doc_id", "text").where(fold_of != held), labels.where(fold_of != held))
    rows = score(docs.select("doc_id", (fold_of == held).alias("held_out"), "text"), lexicon)
    return rows.withColumn("predicted", (F.col("score") >= bar).cast("int"))
