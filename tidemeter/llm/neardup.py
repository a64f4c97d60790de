"""Near duplicates by Jaccard similarity of word n-grams, with vertical partitioning.

The n-grams have one global order: rising number of documents in the corpus, then their key. That order is cut into
fragments at fixed numbers of documents. A document's set falls into one segment per fragment, overlaps are counted
segment by segment, from the rarest fragment to the commonest, and summed for each pair; a pair is given up as soon as
the rest cannot reach the threshold.

Blocks of documents send each of their distinct n-grams once, in packed runs by key range, and get the numbers of
documents back in the same order. Two sets that reach the threshold share an n-gram among the first few of each in the
order (prefix); n-grams of one document only cannot be it, so few n-grams of few documents are left. Equal sets are one
node. The graph of shared prefixes falls into groups, a superset of the answer's. The sets of a group meet once, in
tiles of bounded size; inside a tile, pairs that verified links have already joined need no further count, so copies are
not expanded into pairs. The links' components are the result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.llm.common import WordKeys, components, rolled, stored, text_bytes, words_of

#: The last number of documents of each fragment but the last.
FRAGMENT_ENDS = np.array([1, 3, 15])
#: Numbers of documents from here on count as equal in the order.
MOST = 65_535


def shingle_set(words: list[bytes], keys: WordKeys, size: int) -> np.ndarray:
    """Sorted distinct keys of the runs of ``size`` words; fewer words are one run."""
    if not words:
        return np.empty(0, np.uint64)
    own = keys.of(words)
    return np.unique(rolled(own, size) if len(own) >= size else rolled(own, len(own)) ^ np.uint64(len(own)))


def node_of(grams: np.ndarray) -> int:
    """A key of a whole set; its lowest bit is free."""
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes()) // 2 * 2 - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    """How many n-grams in front must hold a common one for two sets to reach the threshold."""
    return n - -(-percent * n // 100) + 1


class Block:
    """The sets of some documents, their distinct n-grams and in how many of the documents each stands."""

    def __init__(self, texts, size: int):
        keys = WordKeys()
        self.sets = [shingle_set(words_of(text), keys, size) for text in texts]
        every = np.concatenate([np.empty(0, np.uint64), *self.sets])
        self.grams, self.place, counts = np.unique(every, return_inverse=True, return_counts=True)
        self.counts = np.minimum(counts, MOST).astype(np.uint16)
        self.cuts = np.concatenate(([0], np.cumsum([len(s) for s in self.sets])))

    def packets(self, ranges: int):
        """(range, low halves of the keys, counts) of each key range that is not empty.

        A range has few enough keys that their low halves seldom agree. Two n-grams that do are counted as one, which
        moves both to a later place of the order, everywhere alike.
        """
        which = (self.grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.searchsorted(which, np.arange(ranges + 1, dtype=np.uint64))
        return [(r, self.grams[a:b].astype(np.uint32), self.counts[a:b]) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    size: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_bytes: int = 4 << 20,
    range_grams: int = 4_000_000,
    tile_nodes: int = 1024,
    tile_grams: int = 1_000_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): the class of every document under links of similar sets.

    Documents link when 100 * |intersection| >= percent * |union| of their distinct word n-grams; the class is the
    smallest id reachable. Words are runs without ASCII white space, A-Z lower-cased; fewer words than ``size`` count as
    one n-gram; null, empty and blank texts have empty sets and link with nothing. Rows with a null id are left out.
    Rows with one id are one document, whose set is the largest of theirs (then the largest key). Sets and n-grams are
    compared by 64-bit keys. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id IS NOT NULL")
    volume = text_bytes(rows)
    blocks = max(1, math.ceil(volume / block_bytes))
    ranges = max(1, math.ceil(volume / 6 / range_grams))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def send(key, part):
        import pyarrow as pa

        packed = Block(part.column("text").to_pylist(), size).packets(ranges)
        return pa.table(
            {
                "range": pa.array([r for r, _, _ in packed], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(packed), pa.int32()),
                "grams": pa.array([g.tobytes() for _, g, _ in packed], pa.binary()),
                "counts": pa.array([c.tobytes() for _, _, c in packed], pa.binary()),
            }
        )

    def add(key, part):
        import pyarrow as pa

        grams = [np.frombuffer(x.as_buffer(), np.uint32) for x in part.column("grams")]
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in part.column("counts")])
        _, place = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.minimum(np.bincount(place, weights=counts), MOST).astype(np.uint16)[place]
        ends = np.cumsum([len(g) for g in grams])
        return pa.table(
            {
                "block": part.column("block"),
                "range": part.column("range"),
                "totals": pa.array([totals[e - len(g) : e].tobytes() for g, e in zip(grams, ends)], pa.binary()),
            }
        )

    def order(key, part, answers):
        """Size and key of every set; its shared prefix and its segments where others may hold a part of the prefix."""
        import pyarrow as pa

        block = Block(part.column("text").to_pylist(), size)
        totals = [np.empty(0, np.uint16), *(np.frombuffer(x.as_buffer(), np.uint16) for x in answers.sort_by("range").column("totals"))]
        known = np.concatenate(totals)
        if len(known) != len(block.grams):
            raise ValueError(f"{len(known)} counts for {len(block.grams)} n-grams of block {key[0]}")
        frequency = known[block.place]
        prefixes, segments = [], []
        for grams, a, b in zip(block.sets, block.cuts, block.cuts[1:]):
            own = frequency[a:b]
            first = np.lexsort((grams, own))[: prefix_length(len(grams), percent)] if len(grams) else np.empty(0, np.int64)
            shared = np.sort(grams[first[own[first] > 1]])
            prefixes.append(shared.astype(np.int64))
            fragment = np.searchsorted(FRAGMENT_ENDS, own)
            segments.append([grams[fragment == f].tobytes() for f in range(len(FRAGMENT_ENDS) + 1)] if len(shared) else None)
        return pa.table(
            {
                "doc_id": part.column("doc_id"),
                "n": pa.array([len(s) for s in block.sets], pa.int64()),
                "node": pa.array([node_of(s) if len(s) else None for s in block.sets], pa.int64()),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                "segments": pa.array(segments, pa.list_(pa.binary())),
            }
        )

    sent = rows.groupBy("block").applyInArrow(send, "range int, block int, grams binary, counts binary")
    answered = sent.groupBy("range").applyInArrow(add, "block int, range int, totals binary")
    cut = rows.groupBy("block").cogroup(answered.groupBy("block"))
    cut = stored(cut.applyInArrow(order, "doc_id long, n long, node long, prefix array<long>, segments array<binary>"), "neardup-sets")
    sets = cut.groupBy("doc_id").agg(F.max(F.struct("n", "node")).alias("s")).select("doc_id", "s.n", "s.node")
    sets = stored(sets, "neardup-documents")
    sizes = stored(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "neardup-nodes")

    # Linked sets differ in size by the threshold at most, so they fall into one class of sizes or into neighbouring ones.
    step = max(math.log(100 / percent) * 1.000001, 1e-9)
    sized = cut.select(F.explode("prefix").alias("gram"), "node", "n").distinct()
    sized = stored(sized.withColumn("size", F.floor(F.log("n") / step)), "neardup-holders")
    classes = sized.groupBy("gram", "size").agg(F.min("node").alias("first"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("held"))
    classes = stored(classes, "neardup-sizes")
    star = sized.join(classes.where("held > 1"), ["gram", "size"]).select(F.col("node").alias("a"), F.col("first").alias("b"))
    above = classes.select("gram", (F.col("size") - 1).alias("size"), F.col("first").alias("a"), "low")
    beside = classes.drop("low").join(above, ["gram", "size"]).where(F.col("high") * 100 >= F.col("low") * percent)
    groups = components(star.unionByName(beside.select("a", F.col("first").alias("b"))), "neardup-groups")

    members = groups.withColumnRenamed("component", "grp").join(sizes, "node")
    tiles = members.groupBy("grp").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / tile_nodes), F.ceil(F.sum("n") / tile_grams)).cast("int").alias("k")
    )
    members = members.join(tiles, "grp").withColumn("tile", F.pmod(F.hash("node"), F.col("k")))
    # One document stands for a node. Tile i meets every tile j: a set goes once to each, and only once where a group is one tile.
    found = cut.select("doc_id", "node", "prefix", "segments").join(members.drop("n"), ["doc_id", "node"])
    meets = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda j: F.struct(F.least("tile", j).alias("i"), F.greatest("tile", j).alias("j")),
    )
    dealt = found.select("grp", "tile", F.explode(meets).alias("m"), "doc_id", "prefix", "segments").select(
        "grp", "m.i", "m.j", "tile", "doc_id", "prefix", "segments"
    )

    def join(key, part):
        import pyarrow as pa

        edges = join_tile(part, percent)
        return pa.table({"a": np.array([e[0] for e in edges], np.int64), "b": np.array([e[1] for e in edges], np.int64)})

    links_ = stored(dealt.groupBy("grp", "i", "j").applyInArrow(join, "a long, b long"), "neardup-links")
    linked = components(links_, "neardup-classes").select(F.col("node").alias("doc_id"), F.col("component"))
    named = sizes.join(linked, "doc_id", "left").select(F.col("node").alias("key"), F.coalesce("component", "doc_id").alias("component_id"))
    # Every document finds its set's class; a set with very many copies is a key that adaptive execution splits.
    return sets.join(named, F.col("node") == F.col("key"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def join_tile(part, percent: int) -> list[tuple[int, int]]:
    """Links among the documents of one or two tiles, without those that earlier links already join."""
    ids = part.column("doc_id").to_pylist()
    tiles = part.column("tile").to_pylist()
    segments = [[np.frombuffer(s, np.uint64) for s in row] for row in part.column("segments").to_pylist()]
    prefixes = [np.array(p, np.int64) for p in part.column("prefix").to_pylist()]
    n = len(ids)
    if n < 2:
        return []
    sizes = np.array([sum(len(s) for s in row) for row in segments])
    owners = np.repeat(np.arange(n), [len(p) for p in prefixes])
    grams = np.concatenate(prefixes)
    by = np.argsort(grams, kind="stable")
    grams, owners = grams[by], owners[by]
    start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    length = np.diff(np.append(start, len(grams)))
    holders: list[list[np.ndarray]] = [[] for _ in range(n)]
    for s, k in zip(start[length > 1].tolist(), length[length > 1].tolist()):
        own = owners[s : s + k]
        for x in own.tolist():
            holders[x].append(own)
    root = np.arange(n)
    two = len(set(tiles)) > 1
    tile = np.array(tiles)
    edges = []
    for x in np.argsort(sizes, kind="stable").tolist():
        if not holders[x]:
            continue
        others = np.unique(np.concatenate(holders[x]))
        others = others[(root[others] != root[x]) & (others != x)]
        if two:
            others = others[tile[others] != tile[x]]
        # A pair is looked at from its smaller set.
        others = others[(sizes[others] > sizes[x]) | ((sizes[others] == sizes[x]) & (others > x))]
        others = others[100 * sizes[x] >= percent * sizes[others]]
        if not len(others):
            continue
        common = np.zeros(len(others), np.int64)
        rest_x = sizes[x]
        rest = sizes[others].copy()
        for f, own in enumerate(segments[x]):
            rest_x -= len(own)
            parts = [segments[y][f] for y in others]
            lengths = np.array([len(p) for p in parts])
            rest -= lengths
            if len(own) and lengths.sum():
                joined = np.concatenate(parts)
                at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
                sums = np.concatenate(([0], np.cumsum(own[at] == joined)))
                ends = np.cumsum(lengths)
                common += sums[ends] - sums[ends - lengths]
            most = common + np.minimum(rest, rest_x)
            keep = 100 * most >= percent * (sizes[x] + sizes[others] - most)
            others, common, rest = others[keep], common[keep], rest[keep]
            if not len(others):
                break
        for y in others.tolist():
            edges.append((ids[x], ids[y]))
            if root[x] != root[y]:
                root[root == root[y]] = root[x]
    return edges
