"""Best-fit decreasing packing of tokenised documents.

Lengths are whole numbers up to the capacity, so best-fit decreasing over all pieces, however many, is decided by how
many pieces each length has. The plan works on these counts: lengths from the longest on, each put into the open bins
with the tightest room, which a segment tree over remaining capacities finds in logarithmic time; bins with one history
are handled as one group. The plan gives for each length which ranks go to which bins; pieces then find their place by
their rank among those of their length. Its size depends on the capacity, not on the number of documents.

A piece's rank is its place among those of its length in its own partition, plus what the partitions before hold of that
length. So no task ever sees more than a partition's rows, however many pieces share one length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_blocks

CAPACITY, END_ID, MARK = 4096, 1, "\x1c"
CACHED_WORDS = 160_000  # words that a worker keeps; a block of texts with more of them adds its own for as long as it lasts
JOINED, AT_ONCE = 512, 8  # words of one text for the tokenizer, and such texts whose encodings are held at once
BLOCK = 1 << 23  # bytes of text whose words are looked up together
LAST, SIGNS = "[A-Za-z0-9À-ÖØ-öø-ÿ]", "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # a letter or digit, and signs that may end a word behind one

Encode = Callable[[list[str]], list[list[int]]]


class Tree:
    """A segment tree over capacities 0..n; finds the least one at or above a bound that has open bins."""

    def __init__(self, n: int):
        self.size = 1 << (n + 1).bit_length()
        self.has = np.zeros(2 * self.size, dtype=bool)

    def mark(self, at: int, has: bool) -> None:
        node = at + self.size
        self.has[node] = has
        while node > 1:
            node >>= 1
            self.has[node] = self.has[2 * node] or self.has[2 * node + 1]

    def least(self, bound: int) -> int | None:
        node = bound + self.size
        if self.has[node]:
            return bound
        while node > 1:
            if node % 2 == 0 and self.has[node + 1]:  # a left child whose right sister has one
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.size:
            node = 2 * node if self.has[2 * node] else 2 * node + 1
        return node - self.size


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, from_rank, to_rank, first_bin, per_bin, offset): rank t goes to bin first_bin + (t - from_rank) // per_bin, behind the
    pieces there and those of its own length before it. Exactly what best-fit decreasing does piece by piece."""
    tree = Tree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    bins, plan = 0, []

    def leave(room: int, first: int, number: int) -> None:
        if room and number:
            open_.setdefault(room, []).append((first, number))
            tree.mark(room, True)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.least(length)
            if room is None:
                room, per = capacity, capacity // length
                first, number = bins, -(-left // per)
                bins += number
            else:
                first, number = open_[room].pop()
                per = room // length
                if not open_[room]:
                    tree.mark(room, False)
            full = min(number, left // per)
            if full:
                plan.append((length, rank, rank + full * per, first, per, capacity - room))
                leave(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < number:  # fewer than per are left: they share one bin
                plan.append((length, rank, rank + left, first + full, left, capacity - room))
                leave(room - left * length, first + full, 1)
                full, left = full + 1, 0
            leave(room, first + full, number - full)
    return np.array(plan, dtype=np.int64).reshape(-1, 6)


class Words:
    """Ids of texts from ids of their words: no token crosses white space, so each word is encoded once while cached.

    Words are cached in ASCII lower case (the tokenizer lowers case itself) and without the last signs behind a letter or
    digit, which are a token run of their own and cached as a word of theirs. Apostrophes stay, as they may begin a
    contraction, and `<|>` and other signs of added tokens. These are told by their case: a block that may hold one is not lowered.

    `quick` has further ways of encoding words that match a pattern, each with a sign between words that none of them has.
    """

    ENDS = ("", ".", ",")  # always kept; the first is the end of words without one

    def __init__(self, encode: Encode, quick: Iterable[tuple[str, Encode, str]] = (), added: Iterable[str] = ()):
        self.encode = encode
        self.ways = [(pattern, way, sign, self.single(way, sign)) for pattern, way, sign in [*quick, ("", encode, MARK)]]
        added = list(added)
        self.added = os.path.commonprefix(added) if added else None
        signs = "".join(re.escape(c) for c in SIGNS if c not in "".join(added))
        self.run, self.before = f"({LAST})[{signs}]+$", f"^.*{LAST}"
        self.clear()

    @staticmethod
    def single(encode: Encode, sign: str) -> int | None:
        ids = encode([sign])[0]
        return ids[0] if len(ids) == 1 else None

    @property
    def known(self) -> list[str]:
        return self.words.to_pylist()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.starts, self.lengths, self.hits = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.uint32)
        self.add(pa.array(self.ENDS, pa.large_string()))

    @staticmethod
    def joined(words: list[str], encode: Encode, sign: str, mark: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each has. Many words go through the tokenizer as one text, with marks between them."""
        if mark is None or sign in "".join(words):
            ids = encode(words)
            lengths = np.fromiter(map(len, ids), np.int64, len(words))
            return np.fromiter((x for one in ids for x in one), np.uint32, int(lengths.sum())), lengths
        kept, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), JOINED * AT_ONCE):
            part = words[k : k + JOINED * AT_ONCE]
            for ids in encode([f" {sign} ".join(part[j : j + JOINED]) + f" {sign}" for j in range(0, len(part), JOINED)]):
                ids = np.array(ids, np.uint32)
                at = ids == mark
                kept.append(ids[~at])
                lengths.append(np.diff(np.flatnonzero(at), prepend=-1) - 1)
        return np.concatenate(kept), np.concatenate(lengths)

    def add(self, new: pa.Array) -> None:
        starts, lengths, left = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), np.arange(len(new))
        for pattern, encode, sign, mark in self.ways:  # the last takes all that are left
            some = new.take(pa.array(left))
            fits = pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
            flat, n = self.joined(some.filter(pa.array(fits)).to_pylist(), encode, sign, mark)
            at, left = left[fits], left[~fits]
            starts[at], lengths[at] = len(self.flat) + np.cumsum(n) - n, n
            self.flat = np.concatenate([self.flat, flat])
        self.words = pa.concat_arrays([self.words, new])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])

    def ids_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at these places in a row, and the offsets of the words."""
        lengths = self.lengths[places]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[np.repeat(self.starts[places] - ends[:-1], lengths) + np.arange(ends[-1])], ends

    def shrink(self, most: int) -> None:
        """Keeps the `most` words that most blocks have had, ties to the older; their counts are halved, so that words go out of use."""
        ends = len(self.ENDS)
        keep = np.sort(np.append(np.arange(ends), ends + np.argsort(-self.hits[ends:], kind="stable")[: max(0, most - ends)]))
        self.flat, at = self.ids_at(keep)
        self.words = self.words.take(pa.array(keep))
        self.starts, self.lengths, self.hits = at[:-1], np.diff(at), self.hits[keep] // 2

    def places(self, words: pa.Array) -> np.ndarray:
        """Where these words, all different, are in the cache; those that it lacks are added."""
        found = pc.index_in(words, value_set=self.words)
        if found.null_count and len(self.words) + found.null_count > CACHED_WORDS:
            self.shrink(CACHED_WORDS // 2)
            found = pc.index_in(words, value_set=self.words)
        at = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if found.null_count:
            at[at < 0] = len(self.words) + np.arange(found.null_count)
            self.add(words.filter(pc.is_null(found)))
        self.hits[at] += 1
        return at

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and the n + 1 offsets of the texts."""
        lower = pc.ascii_lower(texts)
        if self.added is not None and pc.any(pc.match_substring(lower, self.added)).as_py():
            lower = texts
        parts = pc.ascii_split_whitespace(lower)
        offsets = np.asarray(parts.offsets.to_numpy(zero_copy_only=False), dtype=np.int64)
        offsets = offsets - offsets[0]
        words = parts.flatten().dictionary_encode()
        if not len(words):
            return np.zeros(0, np.uint32), offsets * 0
        each = words.dictionary.cast(pa.large_string())
        stems = pc.replace_substring_regex(each, self.run, "\\1")
        ended = pc.not_equal(pc.binary_length(stems), pc.binary_length(each))
        ends = pc.replace_substring_regex(each.filter(ended), self.before, "")
        both = pa.concat_arrays([stems, ends]).dictionary_encode()
        place = self.places(both.dictionary)[both.indices.to_numpy()]
        pair = np.zeros((len(each), 2), np.int64)
        pair[:, 0], pair[ended.to_numpy(zero_copy_only=False), 1] = place[: len(each)], place[len(each) :]
        flat, at = self.ids_at(pair.ravel())
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(each), [None, pa.py_buffer(4 * at[::2]), pa.py_buffer(flat)])
        taken = data.take(words.indices)
        _, at, flat = taken.buffers()
        at = np.frombuffer(at, np.int64, len(words) + 1)[offsets] // 4
        return np.frombuffer(flat, np.uint32, at[-1]) if at[-1] else np.zeros(0, np.uint32), at


_WORDS: dict[str, Words] = {}


def words_for(tokenizer_path: str) -> Words:
    """One cache for each worker and tokenizer."""
    if tokenizer_path not in _WORDS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        def encoder(tokenizer: Tokenizer) -> Encode:
            return lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

        def unsplit(*more: pre_tokenizers.PreTokenizer) -> Encode:
            """The same model for words that its normalizer leaves as they are and its pattern does not split."""
            tokenizer = Tokenizer(whole.model)
            tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), *more])
            return encoder(tokenizer)

        whole = Tokenizer.from_file(tokenizer_path)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        quick = [("^[a-z]+$", unsplit(), "."), ("^[a-zß-öø-ÿ]+$", unsplit(as_bytes), ".")]
        _WORDS[tokenizer_path] = Words(encoder(whole), quick, [t.content for t in whole.get_added_tokens_decoder().values()])
    return _WORDS[tokenizer_path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and end_id, cut only where longer than capacity.

    A null text is an empty one: a single piece with end_id. Repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_for(tokenizer_path)
        for batch in batches:
            for row, n, texts in text_blocks(batch, most=BLOCK):
                ids, at = words.ids(texts)
                owner, piece, start, length, crc, out_ids = [], [], [], [], [], []
                for k in range(n):
                    one = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    for p, lo in enumerate(range(0, len(one), capacity)):
                        part = one[lo : lo + capacity]
                        owner.append(row + k), piece.append(p), start.append(lo), length.append(len(part)), crc.append(zlib.crc32(part))
                        if with_ids:
                            out_ids.append(part.astype(np.int32))
                columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(out_ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def ranked(cut: DataFrame) -> DataFrame:
    """cut, which must be durable, with _part (its partition) and _r (the row's place among the partition's rows of its length)."""
    names = cut.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(1, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(length):
                continue
            if length.max() >= len(seen):
                seen = np.append(seen, np.zeros(length.max() + 1 - len(seen), np.int64))
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            local = np.empty(len(length), np.int64)
            local[order] = np.arange(len(length)) - np.searchsorted(sorted_, sorted_)
            rank = seen[length] + local
            seen += np.bincount(length, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.full(len(length), part, np.int32)), pa.array(rank)], names=[*names, "_part", "_r"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return cut.mapInArrow(number, f"{schema}, _part int, _r long")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut with sequence_id and offset: best-fit decreasing over its `length` column (1 to capacity).

    cut must be durable: pieces of one length are ranked in the order of its partitions and of their rows, so equal rows,
    however many, are like any others. An empty table stays empty.
    """
    parts = cut.groupBy(F.spark_partition_id().alias("_part"), "length").agg(F.count(F.lit(1)).alias("_n"))
    parts = durable(parts.select("_part", "length", "_n"))  # at most capacity rows a partition
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    plan = best_fit(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = (plan[:, 0] << 44) + plan[:, 1]
    names = cut.columns
    rows = ranked(cut).join(before, ["_part", "length"]).withColumn("_rank", F.col("_r") + F.col("_before"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = plan[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            t = rank - row[:, 1]
            bins, offset = row[:, 3] + t // row[:, 4], row[:, 5] + t % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(bins), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return rows.select(*names, "_rank").mapInArrow(fill, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents; see pieces() and place()."""
    return place(durable(pieces(docs, tokenizer_path, capacity, end_id)), capacity)
