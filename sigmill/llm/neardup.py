"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. Every text becomes its set of word shingles (64-bit hashes) and a signature of HASHES minima. Texts with the same set
   are one class from here on, with a number of its own; a class carries its smallest doc_id.
2. The forest is TREES sorted orders of the classes, each by its own sequence of signature values. In each order a class
   meets the neighbours that share its longest prefixes. How deep a shared prefix must be depends on the region: where
   few classes share the shallowest one, all that do are candidates, and where many do, the order itself brings the
   deepest ones together. A candidate pair must also agree in enough of the whole signature, by a wide margin.
3. Candidate pairs are confirmed on the full sets. First each class's best pairs are, then all those that still join
   different groups; a pair within a group already joined would change nothing. In a crowded region the order leaves
   pairs out: there every class outside the region's main group meets, in blocks of bounded size, all classes of other
   groups, first by signatures alone; those that found a likely partner in a block meet there again with their full sets.
4. Groups are the connected components, contracted in parts of bounded size and then found with large-star and small-star
   steps; hot keys only ever meet in sums that combine before the shuffle, or in joins that can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, marked, marks, release, text_blocks, utf8_block

SHINGLE, HASHES, TREES, DEPTH, LEAST_DEPTH, NEIGHBOURS = 5, 128, 16, 8, 3, 12
PERCENT = 85  # link: 100 * intersection >= PERCENT * union
SLACK = 0.13  # a pair's signatures may agree by so much less than a link's (4 standard errors at PERCENT), before it is dropped
EDGE_BLOCK = 200_000  # edges that one task joins by itself
BLOCK = 256  # classes of a crowded region that are compared at once with as many others

_B = np.uint64(0x100000001B3)
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MUL = _RNG.integers(1, 2**31, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
# Each tree's own order of the signature
_ORDERS = np.stack([_RNG.permutation(HASHES)[:DEPTH] for _ in range(TREES)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased (A-Z) word, and the n + 1 offsets of the texts in them."""
    with np.errstate(over="ignore"):
        b = _FOLD[raw]
        word = ~_GAP[b]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        firsts = at[:-1][at[:-1] < at[1:]]
        begins[firsts] = word[firsts]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
        number = np.cumsum(begins) - 1
        place = np.arange(len(b)) - starts[np.maximum(number, 0)]
        longest = int(place[word].max()) + 1
        power = np.cumprod(np.full(longest, _B, dtype=np.uint64))
        value = np.where(word, _BYTE[b] * power[np.clip(place, 0, longest - 1)], np.uint64(0))
        return mixed(np.add.reduceat(value, starts)), np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, each text's sorted; n + 1 offsets). Fewer than `size` words are one shingle."""
    raw, at = utf8_block(texts)
    words, offsets = word_hashes(raw, at)
    n = np.diff(offsets)
    with np.errstate(over="ignore"):
        if len(words) >= size:
            rolled = words[: len(words) - size + 1].copy()
            for k in range(1, size):
                rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k]
            rolled = mixed(rolled)
        else:
            rolled = np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        whole = np.arange(len(words)) + size <= offsets[1:][owner]
        at_whole = np.flatnonzero(whole)
        hashes, owners = rolled[at_whole], owner[at_whole]
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            one = []
            for k in short:
                h = np.uint64(n[k])
                for w in words[offsets[k] : offsets[k + 1]]:
                    h = h * np.uint64(0x9E3779B97F4A7C15) + w
                one.append(h)
            hashes, owners = np.concatenate([hashes, mixed(np.array(one, np.uint64))]), np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[new], owners[new]
    return hashes, np.searchsorted(owners, np.arange(len(n) + 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of HASHES minima of a set of shingle hashes; in pieces, so that a very long text needs little memory."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(low), 2048):
            v = low[k : k + 2048, None] * _MUL + _ADD
            v ^= v >> np.uint32(15)
            best = np.minimum(best, (v * np.uint32(0x2C1B3C6D)).min(axis=0))
    return best.astype("<u2")  # wraps


def signed(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): the set's size, a 128-bit digest of it, the signature; for an empty set zeros and null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, texts in text_blocks(batch):
                hashes, at = shingle_sets(texts, size)
                counts = np.diff(at)
                d1, d2 = digests(hashes, at)
                sig = [signature(hashes[lo:hi]).tobytes() if hi > lo else None for lo, hi in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), pa.array(counts, pa.int64()), pa.array(d1), pa.array(d2), pa.array(sig, pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def forest(classes: DataFrame) -> DataFrame:
    """classes (class_id, n_shingles, sig) in every tree: (tree, key, class_id, n_shingles, sketch).

    key: the low 16 bits of the tree's DEPTH signature values. sketch: the low 4 bits of every signature value.
    """

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(n, HASHES)
            low = (sigs & 0xF).astype(np.uint8)
            sketch = pa.array([r.tobytes() for r in (low[:, ::2] << 4 | low[:, 1::2])], pa.binary())
            for tree, order in enumerate(_ORDERS):
                keys = np.ascontiguousarray(sigs[:, order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, tree, np.int32)), pa.array([k.tobytes() for k in keys], pa.binary()), batch.column("class_id"), batch.column("n_shingles"), sketch],
                    names=["tree", "key", "class_id", "n_shingles", "sketch"],
                )

    return classes.select("class_id", "n_shingles", "sig").mapInArrow(plant, "tree int, key binary, class_id long, n_shingles long, sketch binary")


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the 4-bit fields of rows of words are equal."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return x.shape[1] * 16 - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def least_share(percent: int) -> float:
    """The share of equal signature values that a candidate pair needs: 4 standard errors below a link's, and SLACK at least."""
    p = percent / 100
    return p - max(SLACK, 4 * (p * (1 - p) / HASHES) ** 0.5)


def least_agreement(percent: int) -> float:
    """The equal fields that a candidate pair needs; one in 16 is equal by chance."""
    share = least_share(percent)
    return (share + (1 - share) / 16) * HASHES


def regions_of(rows: pd.DataFrame) -> np.ndarray:
    """One number for a tree and the first LEAST_DEPTH (3) values of a key."""
    keys = np.frombuffer(b"".join(rows["key"]), "<u2").reshape(len(rows), DEPTH).astype(np.int64)
    return rows["tree"].to_numpy(np.int64) << 48 | keys[:, 0] << 32 | keys[:, 1] << 16 | keys[:, 2]


def neighbours(rows: pd.DataFrame, percent: int = PERCENT, reach: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left id, right id, agreement) of candidate pairs among rows in a tree's order: each row with the `reach` next ones, as far as they share LEAST_DEPTH values."""
    n = len(rows)
    ids, sizes = rows["class_id"].to_numpy(np.int64), rows["n_shingles"].to_numpy(np.int64)
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(n, HASHES // 16)
    region, least = regions_of(rows), least_agreement(percent)
    found = []
    for gap in range(1, min(reach, n - 1) + 1):
        a = np.flatnonzero(region[gap:] == region[:-gap])
        if not len(a):
            break
        b = a + gap
        near = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
        a, b = a[near], b[near]
        agree = agreement(sketch[a], sketch[b])
        ok = (agree >= least) & (ids[a] != ids[b])
        a, b = a[ok], b[ok]
        found.append((np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), agree[ok]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


_PAIRS = "a long, b long, agree int"
_FIELDS = [("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32()), ("border", pa.int64()), ("region", pa.int64()), ("tree", pa.int32()), ("key", pa.binary()), ("class_id", pa.int64()), ("n_shingles", pa.int64()), ("sketch", pa.binary())]
_MET = "a long, b long, agree int, border long, region long, tree int, key binary, class_id long, n_shingles long, sketch binary"


def _batch(n: int, **columns) -> pa.RecordBatch:
    """n rows of _MET with the given columns, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _FIELDS], names=[c for c, _ in _FIELDS])


def scan_orders(trees: DataFrame, percent: int = PERCENT, reach: int = NEIGHBOURS) -> DataFrame:
    """Three kinds of rows of _MET: candidate pairs (a set), rows at the ends of partitions (border set), rows of regions that may be crowded (region set).

    Every order is range-partitioned, so a region of any size is spread over tasks by its deeper values.
    """
    ordered = trees.repartitionByRange("tree", "key", "class_id").sortWithinPartitions("tree", "key", "class_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, head_left = None, reach
        whole = lambda rows, **more: _batch(len(rows), **{c: rows[c] for c in ("tree", "key", "class_id", "n_shingles", "sketch")}, **more)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.to_pandas()
            if head_left:
                head = rows.iloc[:head_left]
                head_left -= len(head)
                yield whole(head, border=np.full(len(head), part))
            region = regions_of(rows)
            _, run, size = np.unique(region, return_inverse=True, return_counts=True)
            crowd = (size[run] > reach) | (region == region[0]) | (region == region[-1])  # at the ends the run may go on
            yield _batch(int(crowd.sum()), region=region[crowd], class_id=rows["class_id"][crowd])
            rows = pd.concat([held, rows], ignore_index=True) if held is not None else rows
            a, b, agree = neighbours(rows, percent, reach)
            if len(a):
                yield _batch(len(a), a=a, b=b, agree=agree)
            held = rows.iloc[-reach:].reset_index(drop=True)
        if held is not None:
            yield whole(held, border=np.full(len(held), part + 1))

    return ordered.mapInArrow(scan, _MET)


def candidates(met: DataFrame, percent: int = PERCENT, reach: int = NEIGHBOURS) -> DataFrame:
    """(a, b, agree), a < b: the pairs of scan_orders, with those across the ends of partitions."""

    def stitch(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, agree = neighbours(rows.sort_values(["tree", "key", "class_id"], kind="stable"), percent, reach)
        return pd.DataFrame({"a": a, "b": b, "agree": agree.astype(np.int32)})

    borders = met.where("border is not null").select("border", "tree", "key", "class_id", "n_shingles", "sketch").groupBy("border").applyInPandas(stitch, _PAIRS)  # 2 * reach rows each
    return met.where("a is not null").select("a", "b", "agree").unionByName(borders).groupBy("a", "b").agg(F.max("agree").alias("agree"))


SALTS = 16  # parts of a region's or component's rows, where they meet what is known of it


def salted(rows: DataFrame, known: DataFrame, key: str, own: str) -> DataFrame:
    """rows (key, own, ...) joined with known, one row per key; a key of very many rows meets it in SALTS tasks, by the hash of own."""
    parts = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")).join(parts, [key, "_salt"]).drop("_salt")


def crowd_of(met: DataFrame, reach: int = NEIGHBOURS) -> DataFrame:
    """(region, class_id) of the regions that hold more classes than the orders compare."""
    rows = met.where("region is not null").select("region", "class_id")
    large = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > reach + 1).select("region")
    return salted(rows, large, "region", "class_id")


def crowd_links(crowd: DataFrame, classes: DataFrame, sets: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that join different groups (node, component) in the regions of crowd, as many as join all that are linked there.

    The classes of a region's main group need not meet each other: they are joined already. All others meet all classes of
    other groups, BLOCK by BLOCK of them: by signatures first, so that only classes with a likely partner in a block send it
    their full sets, on which pairs are confirmed, but for those of a class and a group that one link has joined. A pair
    that shares several regions is tried in the first tree's alone.
    """
    label = groups.select(F.col("node").alias("class_id"), F.col("component"))
    rows = durable(crowd.join(label, "class_id", "left").select("region", "class_id", F.coalesce("component", "class_id").alias("group")))
    by_group = rows.groupBy("region", "group").agg(F.count(F.lit(1)).alias("n"))
    stats = by_group.groupBy("region").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "group")).alias("main"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    stats = durable(stats.where(F.col("groups") > 1).select("region", F.col("main.group").alias("main"), blocks(F.col("total")).alias("nb"), blocks(F.col("total") - F.col("main.n")).alias("no")))
    at = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    least = least_share(percent) * HASHES
    prefixes = _ORDERS[:, :LEAST_DEPTH]
    marked_rows = salted(rows, stats, "region", "class_id").withColumn("odd", F.col("group") != F.col("main"))
    signed_rows = durable(marked_rows.join(classes.select("class_id", "n_shingles", "sig"), "class_id").select("region", "nb", "no", "class_id", "n_shingles", "group", "odd", "sig"))
    names = ["region", "o", "x", "class_id", "n_shingles", "group", "odd", "sig"]
    left = signed_rows.where("odd").withColumn("o", at("no")).withColumn("x", each("nb")).select(*names).toDF(*names)
    right = signed_rows.withColumn("x", at("nb")).withColumn("o", each("no")).select(*names).toDF(*names)

    def likely(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of left, the rows of right that may be linked with it, the likeliest first."""
        sigs = np.frombuffer(b"".join(right["sig"]), "<u2").reshape(len(right), HASHES)
        ids, sizes, group, odd = (right[c].to_numpy() for c in ("class_id", "n_shingles", "group", "odd"))
        tree = int(left["region"].iloc[0]) >> 48
        for k, (own, n, g, sig) in enumerate(zip(left["class_id"], left["n_shingles"], left["group"], left["sig"])):
            sig = np.frombuffer(sig, "<u2")
            can = np.flatnonzero((group != g) & (~odd | (ids > own)) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
            agree = (sigs[can] == sig).sum(axis=1)
            can, agree = can[agree >= least], agree[agree >= least]
            first = (sigs[can][:, prefixes] == sig[prefixes]).all(axis=2).argmax(axis=1) == tree
            yield k, can[first][np.argsort(-agree[first], kind="stable")]

    def hopeful(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """(region, o, x, side, class_id): the rows of either side that have a likely partner in this block."""
        out = pd.DataFrame({c: [] for c in ("region", "o", "x", "side", "class_id")}, dtype="int64")
        if len(left) and len(right):
            both = list(likely(left, right))
            lefts = np.array([k for k, can in both if len(can)], dtype=np.int64)
            rights = np.unique(np.concatenate([can for _, can in both] or [np.zeros(0, np.int64)])).astype(np.int64)
            found = np.concatenate([left["class_id"].to_numpy()[lefts], right["class_id"].to_numpy()[rights]])
            out = pd.DataFrame({"region": left["region"].iloc[0], "o": left["o"].iloc[0], "x": left["x"].iloc[0], "side": np.repeat([0, 1], [len(lefts), len(rights)]), "class_id": found}, dtype="int64")
        return out

    kind = "region long, o long, x long, side long, class_id long"
    hopes = durable(left.groupBy("region", "o", "x").cogroup(right.groupBy("region", "o", "x")).applyInPandas(hopeful, kind))
    whole = hopes.join(signed_rows.drop("nb", "no"), ["region", "class_id"]).join(sets.select(F.col("id").alias("class_id"), "shingles"), "class_id")
    side = lambda k: whole.where(F.col("side") == k).select(*names, "shingles").toDF(*names, "shingles").groupBy("region", "o", "x")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            ids, group = right["class_id"].to_numpy(), right["group"].to_numpy()
            texts = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
            for at_left, can in likely(left, right):
                own, shingles, joined = left["class_id"].iloc[at_left], np.frombuffer(left["shingles"].iloc[at_left], np.uint64), set()
                for k in can:
                    if group[k] in joined:
                        continue
                    common = len(np.intersect1d(shingles, texts[k], assume_unique=True))
                    if 100 * common >= percent * (len(shingles) + len(texts[k]) - common):
                        joined.add(group[k])
                        out.append((min(own, ids[k]), max(own, ids[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    found = durable(side(0).cogroup(side(1)).applyInPandas(meet, "a long, b long").distinct())
    release(rows, stats, signed_rows, hopes)
    return found


def digests(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each of the sets in two numbers, zeros for an empty one: sums over the set, its hashes mixed again with two keys."""
    full = np.flatnonzero(np.diff(at))
    d1, d2 = np.zeros(len(at) - 1, np.uint64), np.zeros(len(at) - 1, np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            d1[full] = np.add.reduceat(mixed(hashes + np.uint64(0x9E3779B97F4A7C15)), at[:-1][full])
            d2[full] = np.add.reduceat(mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93)), at[:-1][full])
    return d1.view(np.int64), d2.view(np.int64)


def shingles_of(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, shingles): the full sets, in bytes, of the classes wanted (class_id, doc_id, d1, d2); durable. Texts stay where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(marks(wanted, "doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column("doc_id")))
            batch = batch.filter(pa.array(marked(bits, batch.column("doc_id").to_numpy(zero_copy_only=False))))
            for row, n, part in text_blocks(batch):
                hashes, at = shingle_sets(part, size)
                d1, d2 = digests(hashes, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n), pa.array(d1), pa.array(d2), pa.array([hashes[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:])], pa.binary())],
                    names=["doc_id", "d1", "d2", "shingles"],
                )

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sets, "doc_id long, d1 long, d2 long, shingles binary")
    own = wanted.select(F.col("class_id").alias("id"), "doc_id", "d1", "d2")
    out = durable(found.join(own, ["doc_id", "d1", "d2"]).select("id", "shingles").dropDuplicates(["id"]))  # a repeated row has the same set
    shared.destroy()
    return out


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets (id, shingles) are linked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_a = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends are in different groups (node, component); a node of no group is one of its own."""
    label = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    labelled = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return labelled.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def contracted(edges: DataFrame, block: int = EDGE_BLOCK) -> tuple[DataFrame, bool]:
    """(edges, whether that is all): the edges (u, v) in parts of about `block`, each part joined within one task and left as edges from its nodes to their smallest."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in batches:
            for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(parent)]
        yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["u", "v"], dtype="int64")

    parts = max(1, -(-edges.count() // block))
    return durable(edges.coalesce(parts).mapInPandas(join, "u long, v long")), parts == 1


def components(edges: DataFrame, block: int = EDGE_BLOCK, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches; of the smallest nodes themselves there are no rows.

    Edges are first contracted in parts of bounded size; if there are several, large-star and small-star steps join them.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"))
    edges, settled = contracted(edges, block)
    for _ in range(most_rounds):
        if settled:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        # large star: larger neighbours of a node are linked to its smallest neighbour
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = durable(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        # settled when every node has one neighbour, which has none itself
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in_")).union(edges.select("v", F.lit(0), F.lit(1)))
        settled = not ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in_").alias("in_")).where("out > 1 or out = 1 and in_ = 1").limit(1).count()
    raise RuntimeError("components did not settle")


def joined_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, component), with all of them joined that links (a, b) join."""
    label = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(between)
    moved = groups.join(over.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    return durable(moved.select("node", F.coalesce("_to", "component").alias("component")).union(over.select("node", "component")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    Texts without words (or null) have an empty set and link with nothing. Rows of one doc_id are one document if their
    texts have the same set; with different sets each is a document of its own, in its own component. A repeated row is
    reported again. Null doc_ids link with nothing and are kept. Extra columns are ignored; an empty table gives one.
    """
    rows = durable(signed(docs, size).select("doc_id", "n_shingles", "d1", "d2", "sig"))
    own = F.min(F.struct("doc_id", "sig")).alias("first")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(own).select("d1", "d2", "n_shingles", F.col("first.doc_id").alias("doc_id"), F.col("first.sig").alias("sig"))
    classes = durable(classes.withColumn("class_id", F.monotonically_increasing_id()))
    met = durable(scan_orders(forest(classes), percent))
    pairs = durable(candidates(met, percent))
    crowd = durable(crowd_of(met))
    release(met)
    nodes = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b")).union(crowd.select("class_id")).distinct()
    wanted = durable(classes.join(nodes, "class_id", "left_semi").select("class_id", "doc_id", "d1", "d2"))
    sets = shingles_of(docs, wanted, size)
    # each class's two best pairs first
    ends = pairs.select(F.col("a").alias("node"), "a", "b", "agree").union(pairs.select(F.col("b").alias("node"), "a", "b", "agree"))
    best = ends.groupBy("node").agg(F.max(F.struct("agree", "a", "b")).alias("x"), F.min(F.struct(-F.col("agree"), "a", "b")).alias("y"))
    first = durable(best.select(F.explode(F.array(F.struct("x.a", "x.b"), F.struct("y.a", "y.b"))).alias("p")).select("p.a", "p.b").distinct())
    groups = components(confirmed(first, sets, percent))
    # then all others that join different groups, and last those of crowded regions
    rest = durable(apart(pairs.select("a", "b").join(first, ["a", "b"], "left_anti"), groups))
    if rest.limit(1).count():
        groups = joined_groups(groups, durable(confirmed(rest, sets, percent)))
    more = crowd_links(crowd, classes, sets, groups, percent)
    if more.limit(1).count():
        groups = joined_groups(groups, more)
    release(pairs, crowd, wanted, sets, first, rest, more)
    # a group's name is its smallest doc_id; a class of no group is one of its own
    linked = groups.select("node", "component").union(groups.select("component", "component").distinct())
    least = linked.join(classes.select(F.col("class_id").alias("node"), "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("name"))
    by_node = salted(linked, least, "component", "node").select("node", "name")
    named = classes.join(by_node, F.col("class_id") == F.col("node"), "left").select("d1", "d2", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()  # these never meet a class, and may be many
    out = rows.where(~empty).select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.where(empty).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """docs, with all their columns, without the rows that near_duplicates() doesn't keep.

    Rows with a null doc_id stay, and all rows of a doc_id one of whose rows is kept. Only rows that may go are joined; all
    others are kept where they are read.
    """
    found = near_duplicates(docs, percent, size).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    dropped = durable(found.where("not kept and doc_id is not null").select("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(marks(dropped, "doc_id"))

    def part(may_go: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                known = pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                may = marked(shared.value, known) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(may == may_go))

        return docs.mapInArrow(run, docs.schema)

    return part(False).unionByName(part(True).join(dropped, "doc_id", "left_anti").select(*docs.columns))
