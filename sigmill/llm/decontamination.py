"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text with at most k edits shares at least m + 1 - q (k + 1) of its character
q-grams with it, all on diagonals (place in the text minus place in the item) within a span of k. Shared q-grams are
counted in diagonal bands of width 2 (k + 1), each overlapping the next by half, so that one band holds them all. Bands
that reach the bound are verified by a banded alignment of the whole item.

Texts are compared in lower case, runs of white space as one blank. Items go out to the tasks in blocks of bounded
size. The documents are read once: a task holds a bounded part of its texts, and every block of items meets that part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, text_blocks

Q, EDIT_RATE = 10, 0.07
BLOCK_CHARS = 1 << 20  # of items that one broadcast holds
TABLES, HELD = 2, 32 << 20  # blocks whose tables a task keeps, and bytes of text that it holds for each round of the others

_LOWER = np.arange(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    if not 0xD800 <= _c < 0xE000:
        _l = chr(_c).lower()
        if len(_l) == 1:
            _LOWER[_c] = ord(_l)
        if chr(_c).isspace():
            _LOWER[_c] = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of all texts as numbers, and the n + 1 offsets of the texts."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return chars, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def normal(chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised characters, offsets of the texts in them, place of each in chars): lower case, white space runs one blank, none at the ends."""
    low = chars.copy()
    small = chars < (1 << 16)
    low[small] = _LOWER[chars[small]]
    first = np.zeros(len(low), bool)
    starts = at[:-1][at[:-1] < at[1:]]
    first[starts] = True
    blank = low == 32
    before = np.concatenate([[True], blank[:-1]]) | first
    keep = ~(blank & before)
    # a blank that ends a text
    last = np.searchsorted(np.flatnonzero(keep), at[1:]) - 1
    kept = np.flatnonzero(keep)
    for k in last:
        if k >= 0 and blank[kept[k]]:
            keep[kept[k]] = False
    kept = np.flatnonzero(keep)
    return low[kept], np.searchsorted(kept, at), kept


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on; as many as there are whole q-grams."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, done, acc = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD), 0, None
        width, factor = 1, _MIX
        while True:  # by doubling widths
            if q & width:
                if acc is None:
                    acc, done = power, width
                else:
                    n = min(len(acc), len(power) - done)
                    acc = acc[:n] * factor + power[done : done + n]
                    done += width
            if width * 2 > q:
                break
            power = power[:-width] * factor + power[width:]
            factor = factor * factor
            width *= 2
        acc = acc[: len(chars) - q + 1]
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        return acc ^ (acc >> np.uint64(32))


class Items:
    """The q-grams of a block of items, by hash, with their places. Items without a character take no part."""

    def __init__(self, ids: list, texts: list[str], q: int = Q, rate: float = EDIT_RATE):
        chars, at = code_points(texts)
        self.chars, self.at, _ = normal(chars, at)
        self.ids = ids
        size = np.diff(self.at)
        # a short item takes shorter q-grams, so that the bound stays at least 1
        self.edits = np.floor(rate * size).astype(np.int64)
        self.q = np.clip((size + 1) // (self.edits + 1) - 1, 1, q)
        self.q = np.where(self.edits == 0, np.minimum(size, q), self.q)
        self.bound = size + 1 - self.q * (self.edits + 1)
        self.tables = {}
        for width in np.unique(self.q[size > 0]):
            hashes, item, place = [], [], []
            for k in np.flatnonzero((self.q == width) & (size > 0)):
                h = gram_hashes(self.chars[self.at[k] : self.at[k + 1]], int(width))
                hashes.append(h), item.append(np.full(len(h), k)), place.append(np.arange(len(h)))
            hashes, item, place = np.concatenate(hashes), np.concatenate(item), np.concatenate(place)
            order = np.argsort(hashes, kind="stable")
            keys, starts = np.unique(hashes[order], return_index=True)
            bits = np.zeros(1 << 22, bool)
            bits[(keys >> np.uint64(42)).astype(np.int64)] = True
            self.tables[int(width)] = (keys, np.append(starts, len(order)), item[order], place[order], bits)


def regions(items: Items, chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, item number, band number) that reach the q-gram bound."""
    keys_out = []
    for width, (keys, starts, item, place, bits) in items.tables.items():
        hashes = gram_hashes(chars, width)
        hit = np.flatnonzero(bits[(hashes >> np.uint64(42)).astype(np.int64)])
        slot = np.searchsorted(keys, hashes[hit])
        same = keys[np.minimum(slot, len(keys) - 1)] == hashes[hit]
        hit, slot = hit[same], slot[same]
        text = np.searchsorted(at, hit, side="right") - 1
        inside = hit + width <= at[text + 1]
        hit, slot, text = hit[inside], slot[inside], text[inside]
        many = starts[slot + 1] - starts[slot]
        rows = np.repeat(np.arange(len(hit)), many)
        post = np.repeat(starts[slot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        which, diagonal = item[post], (hit - at[text])[rows] - place[post]
        step = items.edits[which] + 1
        band = diagonal // step
        size = np.diff(items.at)[which]
        low = 2 + size // step  # bands can start before the text
        key = (text[rows].astype(np.int64) * len(items.ids) + which) << 32
        both = np.concatenate([key + band + low, key + band + low - 1])
        found, n = np.unique(both, return_counts=True)
        who = (found >> 32) % len(items.ids)
        keys_out.append(found[n >= items.bound[who]])
    found = np.concatenate(keys_out) if keys_out else np.zeros(0, np.int64)
    who = (found >> 32) % len(items.ids)
    low = 2 + np.diff(items.at)[who] // (items.edits[who] + 1)
    return (found >> 32) // len(items.ids), who, (found & 0xFFFFFFFF) - low


def align(item: np.ndarray, window: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of the whole item in the window, ties to the earliest end; None if it takes more edits.

    Rows of the alignment are held in a band: column j of row i is window place i + j - edits, so the band covers every
    diagonal of the window that an occurrence within the budget can use.
    """
    m, n = len(item), len(window)
    width = n - m + 2 * edits + 1
    if width <= 0:
        return None
    places = np.arange(width) - edits
    far = m + n + 1
    cost = np.where((places >= 0) & (places <= n), 0, far)
    start = np.clip(places, 0, n)
    offsets = np.arange(width)
    padded = np.concatenate([np.full(edits + 1, -1, np.int64), window.astype(np.int64), np.full(width + 1, -1, np.int64)])
    for i in range(1, m + 1):
        at = i + places
        sub = cost + (padded[i : i + width] != item[i - 1])
        up = np.append(cost[1:], far) + 1
        best = np.minimum(sub, up)
        begin = np.where(sub <= up, start, np.append(start[1:], 0))
        best = np.where((at >= 0) & (at <= n), best, far)
        run = np.minimum.accumulate(best - offsets)
        from_left = run + offsets
        source = np.maximum.accumulate(np.where(best - offsets == run, offsets, 0))
        cost, start = from_left, begin[source]
        if cost.min() > edits:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(start[end]), int(m + places[end])) if cost[end] <= edits else None


def matches(items: Items, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the best occurrence of each item in each text; places in the original text."""
    raw, offsets = code_points(texts)
    chars, at, kept = normal(raw, offsets)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for text, item, band in zip(*(x.tolist() for x in regions(items, chars, at))):
        k = int(items.edits[item])
        step, m = k + 1, int(items.at[item + 1] - items.at[item])
        lo, hi = at[text], at[text + 1]
        a, b = max(lo, lo + band * step - k), min(hi, lo + (band + 2) * step + m + k)
        found = align(items.chars[items.at[item] : items.at[item + 1]], chars[a:b], k) if b > a else None
        if found and ((text, item) not in best or (found[0], a + found[1]) < best[text, item][:2]):
            best[text, item] = (found[0], int(a + found[1]), int(a + found[2]))
    for (text, item), (edits, a, b) in sorted(best.items()):
        yield text, item, int(kept[a] - offsets[text]), int(kept[b - 1] + 1 - offsets[text]), edits


def item_blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of the items in blocks of at most about `most` characters; only one block at a time is on the driver."""
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // most))
    if parts > 1:
        rows = durable(rows)
    for part in range(parts):
        found = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        if found:
            yield [r["item_id"] for r in found], [r["text"] for r in found]


def shipped_items(docs: DataFrame, benchmark: DataFrame) -> list[Broadcast]:
    """(ids, texts) of each block of items, sent out one after another."""
    return [docs.sparkSession.sparkContext.broadcast(block) for block in item_blocks(benchmark)]


def held_parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about `most` bytes; 0: each by itself."""
    part, size = [], 0
    for batch in batches:
        part.append(batch)
        size += batch.nbytes
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


class Blocks:
    """The tables of a task's blocks of items; the first TABLES of them are kept, the others made for each part of the texts."""

    def __init__(self, shipped: list[Broadcast], q: int, rate: float):
        self.shipped, self.q, self.rate = shipped, q, rate
        self.kept: list[Items] = []

    @property
    def held(self) -> int:
        return HELD if len(self.shipped) > TABLES else 0

    def __iter__(self) -> Iterator[Items]:
        for k, one in enumerate(self.shipped):
            if k < len(self.kept):
                yield self.kept[k]
                continue
            items = Items(*one.value, q=self.q, rate=self.rate)
            if one._path is not None:  # a worker would hold every block's texts; they can be read again
                one.__dict__.pop("_value", None)
            if k < TABLES:
                self.kept.append(items)
            yield items


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """(doc_id, item_id, start, end, edits): for each row of docs and each item the best occurrence within the budget.

    The budget is floor(rate * characters of the item) edits; start and end are character places in the original text.
    Rows with a null or empty text have none; items that are null or empty are skipped; repeated items count once, a
    repeated row of docs is reported again. Null doc_ids are reported as such; extra columns are ignored; ids of any type stay as they are.
    """
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    pa_type = to_arrow_type(item_type)
    shipped = shipped_items(docs, benchmark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(shipped, q, rate)
        for part in held_parts(batches, blocks.held):
            for items in blocks:
                for batch in part:
                    for row, _, texts in text_blocks(batch):
                        found = list(matches(items, texts.to_pylist()))
                        if found:
                            owner = batch.column("doc_id").take(pa.array([row + t for t, *_ in found]))
                            rest = [pa.array([f[c] for f in found], pa.int32()) for c in (2, 3, 4)]
                            yield pa.RecordBatch.from_arrays([owner, pa.array([items.ids[f[1]] for f in found], pa_type), *rest], names=["doc_id", "item_id", "start", "end", "edits"])

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {id_type}, item_id {item_type.simpleString()}, start int, end int, edits int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """docs, with all their columns, without the rows in which a benchmark item occurs.

    Null and empty texts stay; null and empty items take no part; repeated rows share one verdict; empty tables change nothing.
    """
    shipped = shipped_items(docs, benchmark)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(shipped, q, rate)
        for part in held_parts(batches, blocks.held):
            clean = [np.ones(batch.num_rows, bool) for batch in part]
            for items in blocks:
                for k, batch in enumerate(part):
                    for row, _, texts in text_blocks(batch):
                        clean[k][[row + t for t, *_ in matches(items, texts.to_pylist())]] = False
            for k, batch in enumerate(part):
                yield batch.filter(pa.array(clean[k]))

    return docs.mapInArrow(drop, docs.schema)
