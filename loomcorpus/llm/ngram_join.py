"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

Every text becomes its set of word n-grams.  All sets are sorted by one global order: n-grams whose
bucket in a sketch of the corpus is crowded come last.  With threshold t, a set of n needs
a = ceil(t n) common n-grams with any partner, so two partners share an n-gram among their first
n - a + 1.  Lengthened by l - 1, two such prefixes share at least l.  Each document chooses its own l
by the estimated cost of its candidates (a longer prefix reads more postings but asks for more
matches before a pair is verified).  A pair that needs c common n-grams shares l = min(l_x, l_y) of
them at places below n - c + l of both; that many are asked for, at those places.  What is left
is held against the whole prefixes: if s is the one whose prefix ends first in the global order, beyond
that end it has n_s - p_s n-grams, so c less those must be shared within.  No link is lost.

Outlines: in lists that many components share, a pair must also pass its sets' outlines.  Bit i of an
outline says whether an odd number of the set's n-grams falls on i, so two outlines differ in no more
bits than the sets have n-grams of their own, n_x + n_y - 2 c at most.  Families of texts that are alike but
below the threshold go here, before they become rows.  And a row that has l common n-grams among the
few before it in both prefixes isn't made: the pair has met l times by then.  Linked pairs pass at each of
their first l, so no link is lost by this either.

Copies: equal sets are one class and are joined once.  Large groups of near copies: before pairs are
made, each member of a crowded posting list is verified against a few fixed leaders of that list; what
is linked so is one component, and pairs are made between different components only; of those, the most promising
of each document is verified first, and the rest where it still joins two components.  So a group of m
near copies doesn't verify m * m pairs.  Components are the same as with all links.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own component;
a text of fewer than n words is one n-gram; equal rows share a class; a null id never becomes a
component id unless all ids of a component are null; other columns are ignored; empty tables give none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcorpus.llm.common import arrow_map, discard, encode, written

U = np.uint64
P1, P2, P3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


@dataclass(frozen=True)
class Params:
    n: int = 4
    percent: int = 85  # link if 100 * common >= percent * union
    max_match: int = 4  # longest l
    sketch_bits: int = 22  # fixed size of the corpus sketch: 2 ** bits counters
    slices: int = 256  # the sketch is summed in so many parts
    crowded: int = 8  # posting lists longer than this get leaders
    leaders: int = 12  # of each crowded list
    outline: int = 1024  # bits of a set's outline, a multiple of 64
    before: int = 8  # n-grams of crowded lists that a row of such a list knows before it
    rounds: int = 1  # of leaders, and then of best candidates
    group: int = 256  # pairs of one set that are verified together
    list_rows: int = 1024  # longer posting lists are dealt into blocks, and these joined with each other
    broadcast_keys: int = 250_000  # wanted classes whose keys are broadcast, of 24 bytes each; more are joined by a shuffle


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * P2
    h = (h ^ (h >> U(27))) * P3
    return h ^ (h >> U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
BLOCK_BYTES = 1 << 18  # texts are hashed together, and long ones in pieces, of about so many bytes
_BASE, _BASE_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < size:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(size, base, dtype=U)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers


def _word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word: found by array operations over all bytes.  The block ends with white space."""
    data = np.frombuffer(block, dtype=np.uint8)
    up, down = _power_tables(len(data))
    space = np.concatenate([[True], _IS_SPACE[data]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_LOWER[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * P1), starts


def _group_shingles(blobs: list[bytes], n: int) -> list[np.ndarray]:
    data, at, hashes, places = b"\n".join([*blobs, b""]), 0, [], []
    while at < len(data):  # cut at white space; only a word longer than a block makes a longer one
        cut = _SPACE.search(data, min(at + BLOCK_BYTES, len(data) - 1)).end()
        h, starts = _word_hashes(data[at:cut])
        hashes.append(h)
        places.append(starts + at)
        at = cut
    h, starts = np.concatenate(hashes), np.concatenate(places)
    first = np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in blobs])).tolist()
    windows = np.zeros(max(0, len(h) - n + 1), dtype=U)
    for k in range(n):
        windows = windows * P1 + h[k : k + len(windows)]
    windows = mix(windows + U(n))
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if 0 < b - a < n:
            whole = np.zeros(1, dtype=U)
            for x in h[a:b]:
                whole = whole * P1 + x
            out.append(mix(whole + U(b - a)))
        else:
            out.append(windows[a : max(a, b - n + 1)])
    return out


def shingles(texts: Iterable[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text, hashes of its word n-grams, in order, repeats included."""
    blobs, size = [], 0
    for text in texts:
        blobs.append(encode(text))
        size += len(blobs[-1])
        if size >= BLOCK_BYTES:
            yield from _group_shingles(blobs, n)
            blobs, size = [], 0
    if blobs:
        yield from _group_shingles(blobs, n)


def needed(size, percent: int):
    """Least number of common n-grams with any partner."""
    if isinstance(size, Column):
        return F.floor((size * percent + 99) / 100)
    return (percent * size + 99) // 100


def sketch(docs: DataFrame, p: Params) -> bytes:
    """Levels of the n-grams by how crowded their bucket is, one byte each.

    All texts are counted.  A task keeps one array of 2 ** sketch_bits small counters, which stop at 2 ** 32 - 1, and
    gives it away in compressed slices, which are summed slice by slice; the result has a fixed size whatever the input.
    """
    bits, parts = p.sketch_bits, p.slices
    width = (1 << bits) // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << bits, dtype=np.uint32), [], 0

        def add() -> None:
            if held:
                places, n = np.unique(np.concatenate(held), return_counts=True)
                total[places] = np.minimum(total[places].astype(np.int64) + n, 0xFFFFFFFF)
                held.clear()

        for batch in batches:
            for x in shingles((t.as_py() for t in batch.column(0)), p.n):
                held.append((x >> U(64 - bits)).astype(np.uint32))
                size += len(x)
                if size > 500_000:
                    add()
                    size = 0
        add()
        for i in range(parts):
            part = total[i * width : (i + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)], pa.binary())], names=["part", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(zlib.decompress(blob.as_buffer()), dtype="<i8")
                if i in sums:
                    sums[i] += x
                else:
                    sums[i] = x.copy()
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(summed, schema).toLocalIterator()
    total = np.zeros(1 << bits, dtype=np.int64)
    for r in rows:
        total[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), dtype="<i8")
    usual = 2 * total.sum() // len(total) + 8
    levels = np.zeros(len(total), dtype=np.uint8)
    full = total > usual
    levels[full] = 1 + np.minimum(30, np.log2(total[full] / usual)).astype(np.uint8)
    return levels.tobytes()


def set_key(s: np.ndarray) -> bytes:
    """128 bits of a sorted set of n-grams."""
    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """Of rows (id, text): id, text_key, set_key (null without words), n, prefix (the longest that any l asks for), outline.

    A prefix token is the level of an n-gram before the upper bits of its hash: its number is the global order.
    """
    levels = docs.sparkSession.sparkContext.broadcast(sketch(docs, p))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        level = np.frombuffer(levels.value, dtype=np.uint8)
        keys, size, prefix, outline = [], [], [], []
        for s in shingles((t.as_py() for t in batch.column(2)), p.n):
            s = np.unique(s)
            n = len(s)
            size.append(n)
            if not n:
                keys.append(None)
                prefix.append(None)
                outline.append(None)
                continue
            keys.append(set_key(s))
            tokens = level[(s >> U(64 - p.sketch_bits)).astype(np.int64)].astype(np.int64) << 57 | (s >> U(7)).astype(np.int64)
            tokens.sort()
            prefix.append(tokens[: min(n, n - needed(n, p.percent) + p.max_match)].copy())
            odd = np.bincount((s % U(p.outline)).astype(np.int64), minlength=p.outline) & 1
            outline.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        cols = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(outline, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "text_key", "set_key", "n", "prefix", "outline"])

    kind = docs.schema["id"].dataType.simpleString()
    keyed = docs.select("id", text_key(), "text")
    return arrow_map(keyed, fn, f"id {kind}, text_key struct<x: long, y: long>, set_key binary, n long, prefix array<long>, outline array<long>")


def text_key() -> Column:
    """128 bits of a text: two hashes with different seeds."""
    return F.struct(F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y")).alias("text_key")


def classes_of(sigs: DataFrame) -> DataFrame:
    """One row for each set: digest (a number given here), set_key, text_key (of a text with that set), n, prefix, outline, least (id).

    The outline is a struct of numbers: its bits are compared in generated code.  Written, so the numbers stay.
    """
    once = sigs.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("text_key").alias("text_key"), F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("n", "prefix", "outline")))
    return once.withColumn("digest", F.monotonically_increasing_id())


def whole_sets(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """(digest, items) of wanted classes (digest, text_key): their texts alone are cut again."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(s) for s in shingles((t.as_py() for t in batch.column(1)), p.n)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "items"])

    keys = wanted.select("digest", "text_key")
    if keys.limit(p.broadcast_keys + 1).count() <= p.broadcast_keys:  # else the texts are shuffled
        keys = F.broadcast(keys)
    texts = docs.select(text_key(), "text").join(keys, "text_key")
    once = texts.groupBy("digest").agg(F.first("text").alias("text"))
    return arrow_map(once, fn, "digest long, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) that link.  The sets travel: one for each pair, and b's once for each p.group pairs that it has.

    So a leader that thousands of members are held against is not one task.
    """
    share = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(p.group)).alias("parts"))
    hot = share.filter("parts > 1")
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"))
    copies = sets.join(share, sets["digest"] == share["b"]).select("b", F.col("items").alias("items_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    one = dealt.join(sets.select(F.col("digest").alias("a"), F.col("items").alias("items_a")), "a")
    both = one.join(copies, ["b", "part"])
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return both.filter(shared * 100 >= (F.size("items_a") + F.size("items_b") - shared) * p.percent).select("a", "b")


#: Links that a task joins at once, with about 100 bytes for each.
TASK_EDGES = 200_000


def forest(edges: DataFrame) -> DataFrame:
    """Of the edges (u, v) of each partition: each node with the smallest that its partition's edges reach, if that is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        ends = [np.concatenate([x[i] for x in parts]) for i in (0, 1)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        u, v = at[: len(ends[0])], at[len(ends[0]) :]
        root = np.arange(len(nodes))
        while True:
            x, y = root[u], root[v]
            apart = x != y
            if not apart.any():
                break
            u, v, x, y = u[apart], v[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
        low = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[low]), pa.array(nodes[root[low]])], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root) of the nodes with links, root the smallest node; edges (a, b).

    Tasks of about task_edges links each join what they hold; what one task can't see is joined by large and small stars
    between them, until nothing changes.  Each round is a written table, so a lost executor costs one round.
    """
    edges = kept = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state, seen = ("count(1) AS n", "bit_xor(xxhash64(u, v)) AS h"), None
    while True:
        now = edges.selectExpr(*state).first()
        if now == seen:
            break
        tasks = -(-now["n"] // task_edges)
        edges, seen = forest(edges.coalesce(max(1, tasks))), now
        if tasks <= 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        hook = large.join(down, "u")
        small = hook.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.withColumnRenamed("m", "v")).distinct()
        edges = written(small, "edges")
        discard(kept)
        kept = edges
    labels = written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "labels")
    discard(kept)
    return labels


def chosen(rows: DataFrame, p: Params) -> DataFrame:
    """(digest, l): the number of matches that makes a document's candidates cheapest.

    With l, its postings hold c(l) other documents; at most c(l) / l of them reach l matches, and each
    of those costs a verification of about n steps.
    """
    base, most = F.col("n") - needed(F.col("n"), p.percent), needed(F.col("n"), p.percent)
    sums = [F.sum(F.when(F.col("pos") < base + l, F.col("df") - 1).otherwise(0)).alias(f"c{l}") for l in range(1, p.max_match + 1)]
    cost = [F.struct((F.col(f"c{l}") + F.col(f"c{l}") * F.col("n") / l).alias("cost"), F.lit(l).alias("l")) for l in range(1, p.max_match + 1)]
    best = F.array_min(F.filter(F.array(*cost), lambda c: c["l"] <= F.greatest(most, F.lit(1))))
    return rows.groupBy("digest").agg(F.first("n").alias("n"), *sums).select("digest", best["l"].alias("l"))


def posting_rows(classes: DataFrame) -> DataFrame:
    """(token, pos, digest, n, df) of prefix n-grams that more than one class has."""
    rows = classes.select("digest", "n", F.posexplode("prefix").alias("pos", "token"))
    df = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return rows.join(df, "token")


def long_enough(x: str, y: str, p: Params):
    """Whether two sizes allow a link."""
    return (F.col(x) * 100 >= F.col(y) * p.percent) & (F.col(y) * 100 >= F.col(x) * p.percent)


def common(p: Params) -> Column:
    """N-grams that a linked pair of n_x and n_y has in common at least."""
    return F.ceil((F.col("n_x") + F.col("n_y")) * p.percent / F.lit(100.0 + p.percent))


def by_prefixes(pairs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) that share enough of their whole prefixes, and how far they exceed that: promise."""
    x = classes.select(F.col("digest").alias("a"), F.col("n").alias("n_x"), F.col("prefix").alias("prefix_x"))
    y = classes.select(F.col("digest").alias("b"), F.col("n").alias("n_y"), F.col("prefix").alias("prefix_y"))
    met = pairs.select("a", "b").join(x, "a").join(y, "b")
    x_first = F.element_at("prefix_x", -1) <= F.element_at("prefix_y", -1)
    left = F.when(x_first, F.col("n_x") - F.size("prefix_x")).otherwise(F.col("n_y") - F.size("prefix_y"))
    least = F.greatest(common(p) - left, F.lit(1))
    shared = F.size(F.array_intersect("prefix_x", "prefix_y"))
    return met.select("a", "b", (shared / least).alias("promise")).filter("promise >= 1")


def leader_pairs(rows: DataFrame, classes: DataFrame, labels: DataFrame, p: Params, round_: int) -> DataFrame:
    """Pairs (a, b) of the members of crowded posting lists with a few leaders each: a fixed number for a member.

    A member goes to the first crowded list in the global order, which few but its near copies share,
    and to its longest list.
    Leaders are the members whose n-grams are the most common: the least edited of a group of near copies.
    """
    crowded = F.when(F.col("df") > p.crowded, F.col("token"))
    lists = F.array_distinct(F.array(F.min(crowded), F.max(F.struct("df", "token"))["token"]))
    mine = rows.groupBy("digest").agg(F.count(crowded).alias("k"), lists.alias("lists"), F.first("n").alias("n"), (F.sum("df") / F.first("n")).alias("score"))
    mine = mine.filter("k > 0").select("digest", "n", "score", F.explode("lists").alias("token"))
    if round_:
        mine = mine.join(labels.withColumnsRenamed({"node": "digest", "root": "label"}), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    else:
        mine = mine.withColumn("label", F.col("digest"))
    salt = F.pmod(F.xxhash64("digest", F.lit(round_)), F.lit(p.leaders))
    heads = mine.groupBy("token", salt.alias("salt")).agg(F.max(F.struct("score", "digest", "n", "label")).alias("h"))
    heads = heads.select("token", F.col("h.digest").alias("b"), F.col("h.n").alias("n_b"), F.col("h.label").alias("label_b"))
    pairs = mine.join(heads, "token").filter((F.col("digest") != F.col("b")) & (F.col("label") != F.col("label_b")) & long_enough("n", "n_b", p))
    pairs = pairs.select(F.col("digest").alias("a"), "b").distinct()
    return by_prefixes(pairs, classes, p).select("a", "b")


def outlines(classes: DataFrame, p: Params) -> DataFrame:
    """(digest, outline) of each class, as a struct of numbers: its bits are compared in generated code."""
    return classes.select("digest", F.struct(*(F.col("outline")[i].alias(f"w{i}") for i in range(p.outline // 64))).alias("outline"))


def meetings(index: DataFrame, shapes: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Rows in which two sets of different components meet at a token, and a table they are read from.  index: token, pos, digest, n, l, label.

    Rows of a list's largest component meet only the others' rows; lists of one component go at once.
    shapes: (digest, outline), looked up for lists that more than p.crowded components share; their rows
    also know the n-grams before them.  A list of more than p.list_rows rows is dealt into blocks by digest;
    each block of the one side meets each block of the other in a group of its own.
    """
    per = index.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    top = per.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("k"), F.ceil(F.sum("c") / F.lit(p.list_rows)).alias("blocks")).filter("k > 1")
    live = index.join(top.select("token", "k", "blocks", F.col("m.label").alias("main")), "token")
    many = F.col("k") > p.crowded
    w = Window.partitionBy("digest").orderBy("pos").rowsBetween(-p.before, -1)
    crowd = live.filter(many).join(shapes, "digest").withColumn("before", F.collect_list("token").over(w))
    # Written: both sides of the join below read it, and the lookup runs once.
    crowd = written(crowd, "crowd")
    live = crowd.unionByName(live.filter(~many), allowMissingColumns=True)
    cols = ["digest", "pos", "n", "l", "label", "outline", "before"]
    mine, all_ = F.pmod(F.xxhash64("digest"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    x = live.filter("label <> main").select("token", mine.alias("block_x"), all_.alias("block_y"), *(F.col(c).alias(f"{c}_x") for c in cols))
    y = live.select("token", mine.alias("block_y"), all_.alias("block_x"), F.col("main"), *(F.col(c).alias(f"{c}_y") for c in cols))
    # Two rows outside the main component meet twice; the smaller digest comes first.
    once = (F.col("label_y") == F.col("main")) | (F.col("digest_x") < F.col("digest_y"))
    l = F.least("l_x", "l_y")
    near = (F.col("pos_x") < F.col("n_x") - common(p) + l) & (F.col("pos_y") < F.col("n_y") - common(p) + l)
    # What both have before this n-gram, the n-gram, and what both have behind it.
    most = F.least("pos_x", "pos_y") + F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    differ = sum(F.bit_count(F.col("outline_x")[f"w{i}"].bitwiseXOR(F.col("outline_y")[f"w{i}"])) for i in range(p.outline // 64))
    alike = F.col("outline_x").isNull() | (differ <= F.col("n_x") + F.col("n_y") - 2 * common(p))
    new = F.col("before_x").isNull() | (F.size(F.array_intersect("before_x", "before_y")) < l)
    return x.join(y, ["token", "block_x", "block_y"]).filter((F.col("label_x") != F.col("label_y")) & once & long_enough("n_x", "n_y", p) & near & (most >= common(p)) & alike & new), crowd


def candidate_pairs(index: DataFrame, shapes: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(a, b) of different components that share l prefix n-grams, and a table they are read from."""
    (met, crowd), l = meetings(index, shapes, p), F.least("l_x", "l_y")
    pair = F.least("digest_x", "digest_y").alias("a"), F.greatest("digest_x", "digest_y").alias("b")
    return met.groupBy(*pair).agg(F.count(F.lit(1)).alias("c"), F.first(l).alias("l")).filter("c >= l").select("a", "b"), crowd


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose documents are in different components."""
    for x in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")), x, "left").withColumn(f"{x}_root", F.coalesce(f"{x}_root", x))
    return pairs.filter("a_root <> b_root").drop("a_root", "b_root")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """One row per document: id, n_shingles, class_id (the smallest id with the same n-gram set; null if empty), component_id."""
    p = params
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = written(signatures(rows, p), "signatures")
    classes, sigs = written(classes_of(whole), "classes"), written(whole.select("id", "n", "set_key"), "documents_sets")
    discard(whole)
    posts = written(posting_rows(classes), "postings")
    labels = sigs.sparkSession.createDataFrame([], "node long, root long")

    def check(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        wanted = written(classes.select("digest", "text_key").join(nodes, "digest"), "wanted")
        sets = written(whole_sets(rows, wanted, p), "sets")
        links = written(verified(pairs, sets, p), "links")
        discard(pairs, wanted, sets)
        return links

    def joined(pairs: DataFrame) -> DataFrame:
        """The labels with the links among these pairs; a component is known by the pairs of its nodes and root."""
        new = check(pairs)
        if new.isEmpty():
            return labels
        out = components(labels.selectExpr("node AS a", "root AS b").unionByName(new))
        discard(new, labels)
        return out

    for i in range(p.rounds):
        labels = joined(leader_pairs(posts, classes, labels, p, i))
    base = F.col("n") - needed(F.col("n"), p.percent)
    index = posts.join(chosen(posts, p), "digest").filter(F.col("pos") < base + F.col("l")).drop("df")
    index = index.join(labels.withColumnsRenamed({"node": "digest", "root": "label"}), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    index = written(index, "index")
    discard(posts)
    met, crowd = candidate_pairs(index, outlines(classes, p), p)
    pairs = written(by_prefixes(met, classes, p), "candidates")
    discard(index, crowd)
    for _ in range(p.rounds):
        best = pairs.groupBy("a").agg(F.max(F.struct("promise", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        labels = joined(best)
        before, pairs = pairs, written(between(pairs, labels), "open_pairs")
        discard(before)
    labels = joined(pairs.select("a", "b")).withColumnRenamed("node", "digest")
    discard(pairs)
    named = classes.select("digest", "set_key", "least").join(labels, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    first = named.groupBy("root").agg(F.min("least").alias("component"))
    names = named.join(first, "root").select("set_key", F.col("least").alias("class_id"), "component")
    out = sigs.select("id", "n", "set_key").join(names, "set_key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """The documents of which each component keeps the one with the smallest id; without words, all stay.

    Rows with the kept id stay all: an id names one document.
    """
    linked = link(docs, id_col, text_col, params)
    keep = linked.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["__keep"]), "left_semi")


def op1_ngram_join(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_shingles, component_id, and class_id for the membership of equal sets."""
    return link(docs).select("doc_id", "n_shingles", "component_id", "class_id")


#: The same by DuckDB over the view documents, for small tables: rare n-grams give the candidates.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[^\x20]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END)) AS s FROM w),
c AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT c, n, unnest(s) AS g FROM c),
f AS (SELECT g, count(*) AS d FROM t GROUP BY g),
o AS (SELECT c, n, t.g, d, row_number() OVER (PARTITION BY c ORDER BY d, t.g) AS r FROM t JOIN f USING (g)),
p AS (SELECT c, n, g FROM o WHERE d > 1 AND r <= n - (85 * n + 99) // 100 + 1),
k AS (SELECT DISTINCT a.c AS a, b.c AS b, a.n AS na, b.n AS nb FROM p a JOIN p b USING (g) WHERE a.c < b.c AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
v AS (SELECT k.a, k.b FROM k JOIN c x ON x.c = k.a JOIN c y ON y.c = k.b
      WHERE 185 * len(list_intersect(x.s, y.s)) >= 85 * (na + nb)),
e AS (SELECT a, b FROM v UNION SELECT b, a FROM v),
reach AS (SELECT c AS node, c AS root FROM c UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.node),
lab AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(lab.root, s.doc_id) AS component_id, c.c AS class_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN lab ON lab.node = c.c"""
