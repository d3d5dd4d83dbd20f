"""Language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are lower-cased words and one end for each text. The model predicts a token's output class from the two tokens
before it: the OUTPUTS most frequent tokens are classes of their own, other words share BUCKETS classes by their last
bytes, and within such a class a word has its smoothed share of the class's count. A context word is one of the most
frequent words or, again, a class of words by their last bytes. With r the context vectors, C1 and C2 matrices, q the
output vectors and b the biases, a class has the log weight (r[c1] C1 + r[c2] C2) . q + b.

As the log weight is a sum over the two context words, its normaliser over all classes for every pair of context classes
is one product of two matrices. So scores are exactly normalised, and a token costs three look-ups.

Counts cover all training texts. Training starts on a small pilot sample, which only breaks the symmetry of the
random start. Then the texts are dealt by a hash into ROUNDS rounds of shards of about SHARD_TOKENS tokens: in a round every
shard is trained on from the same parameters, in an order that the texts alone decide, and the results are averaged by
the number of their tokens. So neither the files nor the cluster change a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_blocks, words_of

OUTPUTS, BUCKETS, CONTEXTS, SHAPES = 2048, 512, 1024, 512  # CONTEXTS holds SHAPES classes by last bytes and one start
HOT = 1 << 19  # most words that are sent to the tasks with their counts; the others are joined
WIDTH, NOISE, BATCH = 16, 64, 8192
PILOT_DOCS, PILOT_EPOCHS = 1500, 3
SHARD_TOKENS, ROUNDS, MOST_SHARDS = 1 << 20, 2, 2048  # of more than MOST_SHARDS shards a round, each is longer instead
SMOOTH = 0.1
BLOCK = 3 << 20


def last_bytes(words: pa.Array, n: int) -> np.ndarray:
    """A number from the last n bytes of each word."""
    out = np.zeros(len(words), np.int64)
    if len(words):
        ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] and ends[-1] else np.zeros(1, np.uint8)
        for k in range(1, n + 1):
            at = ends[1:] - k
            out = out * 257 + np.where(at >= ends[:-1], raw[np.maximum(at, 0)].astype(np.int64) + 1, 0)
    return (out * 2654435761 >> 7) & 0x7FFFFFFF


def counts_of(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the empty word is the end of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, texts in text_blocks(batch, most=BLOCK):
                flat, _ = words_of(texts)
                words = flat.dictionary_encode()
                number = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([""])]), pa.array(np.append(number, n))], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """words, counts: the hot words by falling count, the end among them. total, distinct: of all training tokens. bucket_n, bucket_v: tokens and distinct words of each bucket."""

    words: pa.Array
    counts: np.ndarray
    total: int
    distinct: int
    bucket_n: np.ndarray
    bucket_v: np.ndarray

    @property
    def outputs(self) -> int:
        return min(OUTPUTS, len(self.words))

    def classes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the hot words or -1, output class, context class) of words, each once."""
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = (place >= 0) & (place < self.outputs)
        out = np.where(known, place, self.outputs + last_bytes(words, 3) % BUCKETS)
        top = CONTEXTS - SHAPES - 1
        ctx = np.where((place >= 0) & (place < top), place, top + last_bytes(words, 2) % SHAPES)
        return place, out, ctx

    def prior(self) -> np.ndarray:
        """Smoothed shares of the output classes."""
        n = np.concatenate([self.counts[: self.outputs], self.bucket_n]).astype(np.float64) + 1.0
        return n / n.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: (word, n), each word once. At most HOT words come to the driver: those whose count is so high that no more have it."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    sizes = sorted(((r["n"], r["v"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("n")).limit(HOT).collect()), reverse=True)
    bar, sum_ = None, 0
    for n, v in sizes:
        if sum_ + v > HOT:
            break
        bar, sum_ = n, sum_ + v
    hot = counts.where(F.col("n") >= (bar if bar is not None else 1 << 62)).select("word", "n").toArrow().combine_chunks()
    hot = hot.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    flat = lambda name, kind: pa.concat_arrays(hot[name].chunks).cast(kind) if hot.num_rows else pa.array([], kind)
    words, number = flat("word", pa.string()), flat("n", pa.int64()).to_numpy()
    shared = counts.sparkSession.sparkContext.broadcast(Vocabulary(words.slice(0, OUTPUTS), number[:OUTPUTS], total, distinct, np.zeros(BUCKETS), np.zeros(BUCKETS)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
        top = shared.value
        for batch in batches:
            _, out, _ = top.classes(batch.column("word"))
            rest = out >= top.outputs
            n += np.bincount(out[rest] - top.outputs, weights=batch.column("n").to_numpy()[rest], minlength=BUCKETS)
            v += np.bincount(out[rest] - top.outputs, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(n.astype(np.int64)), pa.array(v.astype(np.int64))], names=["bucket", "n", "v"])

    bucket_n, bucket_v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.select("word", "n").mapInArrow(fill, "bucket long, n long, v long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # BUCKETS rows
        bucket_n[r["bucket"]], bucket_v[r["bucket"]] = r["n"], r["v"]
    shared.destroy()
    return Vocabulary(words, number, total, distinct, bucket_n, bucket_v)


@dataclass
class Tokens:
    """Of a block of texts: the distinct words and, last, the end; each token's number among them, output class and two context classes; offsets of the texts."""

    words: pa.Array
    number: np.ndarray
    out: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    at: np.ndarray
    place: np.ndarray


def tokens_of(texts: pa.Array, vocab: Vocabulary) -> Tokens:
    flat, counts = words_of(texts)
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.string())
    both = pa.concat_arrays([words, pa.array([""])])
    place, out, ctx = vocab.classes(both)
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    number = np.full(at[-1], len(words), np.int64)
    inner = np.ones(at[-1], bool)
    inner[at[1:] - 1] = False
    number[inner] = coded.indices.to_numpy(zero_copy_only=False)
    c = ctx[number]
    start = CONTEXTS - 1
    c1, c2 = np.empty_like(c), np.empty_like(c)
    c1[1:], c2[2:] = c[:-1], c[:-2]
    c1[at[:-1]] = c2[at[:-1]] = start
    second = at[:-1] + 1
    c2[second[second < at[1:]]] = start
    return Tokens(both, number, out[number], c1, c2, at, place)


class Model:
    """The parameters, with AdaGrad's sums of squares."""

    NAMES = ("r", "m1", "m2", "q", "b")

    def __init__(self, vocab: Vocabulary, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.noise = vocab.prior()
        n = len(self.noise)
        self.r = rng.normal(0, 0.1, (CONTEXTS, WIDTH)).astype(np.float32)
        self.m1, self.m2 = np.eye(WIDTH, dtype=np.float32), (0.7 * np.eye(WIDTH)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        self.b = np.log(self.noise).astype(np.float32)
        self.squares = {k: np.full_like(getattr(self, k), 0.1) for k in self.NAMES}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def copy(self) -> Model:
        """One with parameters of its own."""
        out = Model.__new__(Model)
        out.__dict__ = {k: (v.copy() if isinstance(v, np.ndarray) else v) for k, v in self.__dict__.items()}
        out.squares = {k: v.copy() for k, v in self.squares.items()}
        return out

    def load(self, flat: np.ndarray) -> None:
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[: old.size].reshape(old.shape).astype(np.float32))
            flat = flat[old.size :]

    def train(self, out: np.ndarray, c1: np.ndarray, c2: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """Noise-contrastive steps over the tokens in random order; NOISE samples are shared by a batch."""
        chances = np.cumsum(self.noise)
        order = rng.permutation(len(out))
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            o, x1, x2 = out[rows], c1[rows], c2[rows]
            noise = np.minimum(np.searchsorted(chances, rng.random(NOISE)), len(chances) - 1)
            r1, r2 = self.r[x1], self.r[x2]
            h = r1 @ self.m1 + r2 @ self.m2
            qo, qn = self.q[o], self.q[noise]
            real = np.einsum("ij,ij->i", h, qo) + self.b[o] - log_noise[o]
            fake = h @ qn.T + (self.b[noise] - log_noise[noise])
            g = (-1 / (1 + np.exp(np.clip(real, -30, 30)))).astype(np.float32)  # of the real tokens
            w = (1 / (1 + np.exp(-np.clip(fake, -30, 30)))).astype(np.float32)  # of the noise
            dh = g[:, None] * qo + w @ qn
            n = np.float32(1 / len(rows))
            dq = scatter(o, g[:, None] * h, len(self.q))
            np.add.at(dq, noise, w.T @ h)
            db = np.bincount(o, weights=g, minlength=len(self.b)) + np.bincount(noise, weights=w.sum(axis=0), minlength=len(self.b))
            dr = scatter(x1, dh @ self.m1.T, CONTEXTS) + scatter(x2, dh @ self.m2.T, CONTEXTS)
            for name, grad in (("q", dq), ("b", db.astype(np.float32)), ("r", dr), ("m1", r1.T @ dh), ("m2", r2.T @ dh)):
                grad = grad * (n * np.float32(64))
                square = self.squares[name]
                square += grad * grad
                setattr(self, name, getattr(self, name) - rate * grad / np.sqrt(square))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, second, normaliser): the log10 probability of class o after c2, c1 is first[c1, o] + second[c2, o] - normaliser[c1, c2]."""
        first = (self.r @ self.m1 @ self.q.T + self.b).astype(np.float64)
        second = (self.r @ self.m2 @ self.q.T).astype(np.float64)
        top1, top2 = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        z = np.exp(first - top1) @ np.exp(second - top2).T
        ten = np.log(10.0)
        return (first / ten).astype(np.float32), (second / ten).astype(np.float32), ((np.log(z) + top1 + top2.T) / ten).astype(np.float32)


def scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of value rows by row number."""
    width = values.shape[1]
    keys = (rows[:, None] * width + np.arange(width)).ravel()
    return np.bincount(keys, weights=values.ravel(), minlength=n * width).reshape(n, width).astype(np.float32)


def trained(docs: DataFrame, vocab: Vocabulary) -> Model:
    """A model of all texts of docs (doc_id, text)."""
    model = Model(vocab)
    if not vocab.total:
        return model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)

    def pilot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_blocks(batch, most=BLOCK):
                t = tokens_of(texts, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i2").tobytes()], pa.binary()) for x in (t.out, t.c1, t.c2)], names=["out", "c1", "c2"])

    number = docs.count()
    few = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) <= int(min(1.0, PILOT_DOCS / max(1, number)) * 1_000_000)).select("text").dropDuplicates(["text"])  # copies share a hash
    rows = few.orderBy(F.xxhash64("text"), "text").mapInArrow(pilot, "out binary, c1 binary, c2 binary").collect()  # of about PILOT_DOCS texts
    rng = np.random.default_rng(3)
    out, c1, c2 = (np.concatenate([np.frombuffer(r[c], "<i2") for r in rows] or [np.zeros(0, "<i2")]).astype(np.int64) for c in ("out", "c1", "c2"))
    del rows
    for epoch in range(PILOT_EPOCHS):
        model.train(out, c1, c2, rng, rate=0.1)
    shards = int(min(MOST_SHARDS, max(1, -(-vocab.total // (ROUNDS * SHARD_TOKENS)))))
    groups = max(1, int(shards**0.5))
    key = F.xxhash64("doc_id", "text")
    for round_ in range(ROUNDS):
        begun = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], begun=begun) -> Iterator[pa.RecordBatch]:
            own, shard, number, rng = None, None, 0, None

            def result() -> pa.RecordBatch:
                flat = (own.flat().astype(np.float64) * number).tobytes()
                return pa.RecordBatch.from_arrays([pa.array([shard % groups]), pa.array([flat], pa.binary()), pa.array([number])], names=["part", "total", "n"])

            for batch in batches:
                of = batch.column("shard").to_numpy()
                edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if of[lo] != shard:
                        if number:
                            yield result()
                        shard, number, rng = int(of[lo]), 0, np.random.default_rng((round_, int(of[lo])))
                        own = begun.value.copy()
                    for _, _, texts in text_blocks(batch.slice(lo, hi - lo), most=BLOCK):
                        t = tokens_of(texts, shared.value)
                        own.train(t.out, t.c1, t.c2, rng, rate=0.1)
                        number += len(t.out)
            if number:
                yield result()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for part, total, n in zip(*(batch.column(c).to_pylist() for c in ("part", "total", "n"))):
                    if part in sums:
                        sums[part][0] += np.frombuffer(total)
                        sums[part][1] += n
                    else:
                        sums[part] = [np.frombuffer(total).copy(), n]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], names=["total", "n"])

        dealt = docs.select(key.alias("h"), "text").where(F.pmod("h", F.lit(ROUNDS)) == round_).withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards)))
        dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "text").select("shard", "text")
        totals = dealt.mapInArrow(run, "part long, total binary, n long").repartition(groups, "part").mapInArrow(add, "total binary, n long").collect()  # about a root of the shards
        if totals:
            model.load(sum(np.frombuffer(r["total"]) for r in totals) / sum(r["n"] for r in totals))
        begun.destroy()
    shared.destroy()
    return model


def scores(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """docs without the text, with n_tokens, n_known, base_score and score. Words that aren't hot meet their counts in a join."""
    names = [c for c in docs.columns if c != "text"]
    first, second, normaliser = model.tables()
    shared = docs.sparkSession.sparkContext.broadcast((vocab, first, second, normaliser))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, first, second, normaliser = shared.value
        hot = np.append(np.log10(vocab.counts + SMOOTH), 0.0)  # a word that isn't hot adds its own later
        whole = np.log10(vocab.total + SMOOTH * (vocab.distinct + 1))
        own = np.concatenate([np.zeros(vocab.outputs), np.log10(vocab.bucket_n + SMOOTH * (vocab.bucket_v + 1))])
        base_id, row_id = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for row, n, texts in text_blocks(batch, most=BLOCK):
                t = tokens_of(texts, vocab)
                place = t.place[t.number]
                log_count = hot[place]
                logp = first[t.c1, t.out] + second[t.c2, t.out] - normaliser[t.c1, t.c2] - own[t.out]
                logp = np.where(t.out >= vocab.outputs, logp + log_count, logp)
                sums = lambda x: np.add.reduceat(x, t.at[:-1])
                ids = base_id + row_id + np.arange(n)
                row_id += n
                cold = np.flatnonzero(place < 0)
                owner = np.searchsorted(t.at, cold, side="right") - 1
                key, many = np.unique(owner * len(t.words) + t.number[cold], return_counts=True)
                owner, word = key // len(t.words), key % len(t.words)
                k = len(key)
                # a text's own row has a key with a blank, as no word has
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids, base_id + row_id - n + owner])),
                        pa.concat_arrays([pa.array([f" {i}" for i in ids], pa.string()), t.words.take(pa.array(word))]),
                        pa.concat_arrays([pa.array(np.diff(t.at)), pa.array(many.astype(np.int64))]),
                        pa.concat_arrays([pa.array(sums((place >= 0).astype(np.int64))), pa.nulls(k, pa.int64())]),
                        pa.concat_arrays([pa.array(sums(log_count - whole)), pa.nulls(k, pa.float64())]),
                        pa.concat_arrays([pa.array(sums(logp.astype(np.float64))), pa.nulls(k, pa.float64())]),
                        *[pa.concat_arrays([batch.column(c).slice(row, n), pa.nulls(k, batch.column(c).type)]) for c in names],
                    ],
                    names=["_row", "_word", "_n", "_known", "_base", "_score", *names],
                )

    schema = "_row long, _word string, _n long, _known long, _base double, _score double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    rows = docs.mapInArrow(run, schema)
    joined = rows.join(counts.select(F.col("word").alias("_word"), F.col("n").alias("_c")), "_word", "left")
    own = F.col("_score").isNotNull()
    later = F.when(~own, F.col("_n") * F.log10(F.coalesce("_c", F.lit(0)) + F.lit(SMOOTH)))
    known = F.when(own, F.col("_known")).otherwise(F.when(F.col("_c") > 0, F.col("_n")).otherwise(0))
    out = joined.groupBy("_row").agg(
        F.max(F.when(own, F.struct(*names))).alias("_own"),
        F.sum(F.when(own, F.col("_n"))).alias("n_tokens"),
        F.sum(known).alias("n_known"),
        F.sum(F.coalesce("_base", later)).alias("base_score"),
        F.sum(F.coalesce("_score", later)).alias("score"),
    )
    return out.select(*[F.col(f"_own.{c}").alias(c) for c in names], "n_tokens", "n_known", "base_score", "score")


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text).

    The model and the counts come from the rows where held_out is false. A null or empty text is its end alone. Repeated
    rows each count and are each scored; a null doc_id is one like any other. Extra columns are ignored. Without any training
    row all tokens are unknown; an empty table gives one.
    """
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    train = rows.where(~F.col("held_out")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = durable(counts_of(train))
    vocab = vocabulary(counts)
    model = trained(train, vocab)
    out = scores(rows, counts, vocab, model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
