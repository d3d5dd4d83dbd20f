"""Language identification by hierarchical discrimination.

A text's features are the shares of its hashed byte trigrams (letters and their accents; all else is one blank). Linear
one-versus-rest support vector machines choose the language family; within the family, one linear support vector
machine for each pair of languages votes. All machines are linear in counts, so a text's margins are sums of weights
over its trigrams divided by their number, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, text_blocks, utf8_block

# Families of related languages by code. Any other code is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "indic": ["hi", "ur", "bn", "mr", "ne", "pa", "gu"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he", "mt", "am"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

SIZE, SCALE = 4096, 64.0
TRAIN_ROWS = 1500  # training rows of each language, about this many at most
MOST_LANGS = 200  # languages that are learned, at most
UNKNOWN = "und"

_FOLD = np.full(256, 32, dtype=np.uint32)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        _FOLD[_b] = _b


def trigrams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigram of each byte position, whether it counts): those within one text that aren't all blank in the middle."""
    b = _FOLD[raw]
    out, counts = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
    if len(b) > 2:
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        out[:-2] = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
        counts[:-2] = b[1:-1] != 32
        for end in at[1:]:  # not across the ends of texts
            counts[max(0, end - 2) : end] = False
    return out, counts


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, f"only {lang}")


class Rows:
    """Sparse rows of SIZE columns: the values of row k are values[at[k] : at[k + 1]], their columns likewise."""

    def __init__(self, columns: np.ndarray, values: np.ndarray, at: np.ndarray):
        self.columns, self.values, self.at = columns, values, at

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns, values, which of the asked rows) of all entries of rows."""
        many = self.at[rows + 1] - self.at[rows]
        entries = np.repeat(self.at[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return self.columns[entries], self.values[entries], np.repeat(np.arange(len(rows)), many)


def svm(design: Rows, own: np.ndarray, y: np.ndarray, ridge: float = 1e-4, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (constant last) of a linear support vector machine on the rows `own` of design; their y is 1 or -1, both sides weighing the same."""
    rng = np.random.default_rng(seed)
    side = {s: 0.5 / max(1, (y == s).sum()) * len(y) for s in (1, -1)}
    cost = np.where(y > 0, side[1], side[-1])
    w, mean, t = np.zeros(SIZE + 1), np.zeros(SIZE + 1), 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            t += 1
            rate = 1 / (ridge * (t + 2000))
            columns, values, which = design.take(own[rows])
            target = y[rows]
            wrong = target * (np.bincount(which, values * w[columns], len(rows)) + w[-1]) < 1
            push = cost[rows] * target * wrong * (rate * 0.05 / len(rows))
            w *= 1 - rate * ridge
            w[:-1] += np.bincount(columns, values * push[which], SIZE)
            w[-1] += push.sum()
            if epoch >= epochs // 2:
                mean += w
    steps = t - sum(len(np.array_split(np.arange(len(y)), max(1, len(y) // 32))) for _ in range(epochs // 2))
    return mean / max(1, steps)


class Model:
    """langs: sorted. families: sorted names. machines: rows of weights (SIZE + 1); first one for each family, then one for each pair."""

    def __init__(self, langs: list[str], design: Rows, y: np.ndarray):
        self.langs = sorted(langs)
        self.families = sorted({family_of(lang) for lang in self.langs})
        of = np.array([family_of(lang) for lang in y])
        rows = [svm(design, np.arange(len(y)), np.where(of == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = [(a, b) for a, b in combinations(self.langs, 2) if family_of(a) == family_of(b)]
        for a, b in self.pairs:
            own = np.flatnonzero((y == a) | (y == b))
            rows.append(svm(design, own, np.where(y[own] == a, 1, -1)))
        self.machines = np.array(rows, dtype=np.float32).reshape(-1, SIZE + 1)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score 0 to 1) for rows of margins."""
        n, f = len(margins), len(self.families) if len(self.families) > 1 else 0
        chance = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
        if f:
            family = margins[:, :f].argmax(axis=1)
            each = chance(margins[:, :f]) + 1e-12
            sure = each[np.arange(n), family] / each.sum(axis=1)
        else:
            family, sure = np.zeros(n, np.int64), np.ones(n)
        votes = np.full((n, len(self.langs)), -np.inf)
        for k, lang in enumerate(self.langs):
            votes[family == self.families.index(family_of(lang)), k] = 0.0
        least = np.ones((n, len(self.langs)))
        for k, (a, b) in enumerate(self.pairs):
            p = chance(margins[:, f + k])
            for lang, q in ((a, p), (b, 1 - p)):
                at = self.langs.index(lang)
                votes[:, at] += (q >= 0.5) + 1e-3 * q  # ties of votes go to the surer side
                least[:, at] = np.minimum(least[:, at], q)
        best = votes.argmax(axis=1)
        return best, sure * least[np.arange(n), best]


def counted(docs: DataFrame) -> DataFrame:
    """(lang, columns, counts): for each row its trigrams, as bytes of 16-bit numbers, and how often each occurs, as bytes of 32-bit numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, texts in text_blocks(batch):
                raw, at = utf8_block(texts)
                grams, use = trigrams(raw, at)
                columns, counts = [], []
                for lo, hi in zip(at[:-1], at[1:]):
                    number = np.bincount(grams[lo:hi][use[lo:hi]], minlength=SIZE)
                    found = np.flatnonzero(number)
                    columns.append(found.astype("<u2").tobytes())
                    counts.append(number[found].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(row, n), pa.array(columns, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "columns", "counts"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, columns binary, counts binary")


def sampled(docs: DataFrame) -> tuple[Rows, np.ndarray]:
    """The sparse rows of the shares of trigrams, times SCALE, and their languages; the order of the rows is that of their contents."""
    rows = counted(docs).orderBy("lang", "columns", "counts").toArrow().combine_chunks()
    whole = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
    columns, counts = whole("columns", "<u2"), whole("counts", "<u4")
    at = np.concatenate([[0], np.cumsum([len(x) // 2 for x in rows.column("columns").to_pylist()], dtype=np.int64)])
    total = np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), counts, len(at) - 1)
    values = (counts * (SCALE / np.repeat(np.maximum(1, total), np.diff(at)))).astype(np.float32)
    return Rows(columns, values, at), np.array(rows.column("lang").to_pylist(), dtype=object)


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS, most_langs: int = MOST_LANGS) -> Model | None:
    """The model from rows of docs with text and lang; None if there are none.

    Of each language about train_rows distinct texts at most, chosen by a hash of the text, so copies count once and the
    order and the partitions of docs don't matter. Of more than most_langs values of lang (a spoiled column) those with the
    most texts are learned, ties in their order. Null texts and languages take no part; extra columns are ignored.
    """
    rows = docs.select("lang", "text").where("text is not null and lang is not null")
    texts = rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # copies once, as in the sample
    sizes = {r["lang"]: r["n"] for r in texts.orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not sizes:
        return None
    rate = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, int(min(1.0, train_rows / n) * 1_000_000))])
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < rate[F.col("lang")]).dropDuplicates(["lang", "text"])  # copies share a hash
    design, y = sampled(chosen)  # about train_rows rows a language, a few kilobytes each
    model = Model(list(sizes), design, y)
    give_back()
    return model


def verdicts(batch: pa.RecordBatch, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """(predicted language, score) of the texts of a batch."""
    langs, scores = [np.zeros(0, dtype=object)], [np.zeros(0)]
    for _, n, texts in text_blocks(batch):
        raw, at = utf8_block(texts)
        ascii_letter = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
        has = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
        for k in np.flatnonzero(~has & (np.diff(at) > 0)):
            has[k] = any(c.isalpha() for c in texts[int(k)].as_py())
        pred, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
        if model is not None and len(raw):
            grams, use = trigrams(raw, at)
            number = np.concatenate([[0], np.cumsum(use)])
            number = np.maximum(1, number[at[1:]] - number[at[:-1]])
            margins = np.empty((n, len(model.machines)))
            for m, w in enumerate(model.machines):
                sums = np.concatenate([[0.0], np.cumsum(np.where(use, w[:-1][grams], 0), dtype=np.float64)])
                margins[:, m] = (sums[at[1:]] - sums[at[:-1]]) / number * SCALE + w[-1]
            best, sure = model.decide(margins)
            pred[has], score[has] = np.array(model.langs, dtype=object)[best[has]], sure[has]
        langs.append(pred)
        scores.append(score)
    return np.concatenate(langs), np.concatenate(scores)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the text, with lang_pred and score in place of any columns of these names. A null text, or one without a letter, is `und` with score 0; so is all without a model."""
    docs = docs.drop("lang_pred", "score")
    names = [c for c in docs.columns if c != "text"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = verdicts(batch, model)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(langs, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(predict, f"{schema}, lang_pred string, score double")


def reject(docs: DataFrame, model: Model | None, bar: float = 0.3) -> DataFrame:
    """docs, with all their columns, without the rows of no language (`und`) or whose language scores below `bar`.

    So null and empty texts go, and without a model all rows; repeated rows share one verdict; an empty table stays empty.
    """

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = verdicts(batch, model)
            yield batch.filter(pa.array((langs != UNKNOWN) & (scores >= bar), pa.bool_()))

    return docs.mapInArrow(drop, docs.schema)


def classify(docs: DataFrame, held: int = 2, folds: int = 4) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs: learned from rows whose crc32(doc_id as text) mod folds is not `held`.

    A null doc_id counts as the empty text in the fold; a null text, or one without a letter, is `und` with score 0; repeated
    rows are repeated, extra columns ignored, and an empty table gives one.
    """
    fold_of = crc_mod(F.col("doc_id"), folds)
    model = learn(docs.where(fold_of != held))
    return identify(docs.select("doc_id", (fold_of == held).alias("held_out"), "text"), model)
