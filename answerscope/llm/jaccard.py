"""N-gram Jaccard join with signature trees (operator 9): documents whose sets of five-word shingles overlap by 0.8 or more.

1. A document's set is its distinct shingles as 64-bit hashes. Equal sets are one node from here on.
2. Candidates share a token. In the order of the hashes, two sets that overlap enough have at least f common tokens among their first
   |x| - ceil(0.8 |x|) + f ones (`heads`). The tokens of the heads are counted over all documents; a head whose tokens are mostly its
   own can't have a partner. The rest keep, rarest first, as many tokens as must hold one that a partner keeps too.
   So no frequent token brings documents together that don't consist of frequent tokens.
3. Tokens that the same documents keep count once, and tokens with the same least document are a family: its documents meet together,
   in blocks, every two blocks at a place of their own.
4. At a place signature trees are built over the blocks: leaves hold a document's size and token bitmap, inner nodes the OR of the bitmaps
   and the range of sizes. Two trees (or one with itself) are traversed together; a pair of nodes is left when the largest overlap possible is too small.
5. Every pair of documents that remains is compared exactly in the task, at the least family that both belong to. What leaves the task is each document's
   number of links and one edge to the least document that the place's links lead to; components of the edges are found by alternating stars.

No step loses a link: a pair is left out only when it can't link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, column, prepare, save, table, text_or_empty

WORDS, PERCENT = 5, 80
#: Words whose hashes a Python worker remembers.
MAX_KEPT = 300_000
#: Bits of a document's signature, children of a tree node, rows of one tree.
BITS, FANOUT, TREE_ROWS = 2048, 8, 1024
#: Members of the sets of one block, on average: long sets make smaller blocks.
BLOCK_MEMBERS = 2_000_000
_K = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = WordHashes()


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `size` words; fewer words are one shingle, no words none. Only A-Z are lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) < size:
        mixed = np.full(1, len(words), dtype=np.uint64)
        for x in ids:
            mixed = mixed * _K + x
    else:
        n = len(ids) - size + 1
        mixed = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            mixed = mixed * _K + ids[i : i + n]
    return np.unique(scrambled(mixed).view(np.int64))


def needed(n: int, percent: int = PERCENT) -> int:
    """Common shingles that a set of n needs at least: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def common_in_heads(n: int) -> int:
    """How many common tokens the heads of a set of n are made to hold; never falls as n grows."""
    return max(1, n // 16)


def head_length(n: int, percent: int = PERCENT) -> int:
    return min(n, n - needed(n, percent) + common_in_heads(n))


def own_allowed(n: int, percent: int = PERCENT) -> int:
    """Tokens of the head, rarest first, among which one common token must be: partners have needed(n) shingles or more, so the
    heads have common_in_heads(needed(n)) common tokens or more."""
    return head_length(n, percent) - common_in_heads(needed(n, percent)) + 1


def sketched(docs: DataFrame, text: str, percent: int) -> DataFrame:
    """n, s0 and s1 (a 128-bit hash of the set), head, its length, and keep (own_allowed) instead of the text."""
    others = [c for c in docs.columns if c != text]
    fields = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n bigint", "s0 bigint", "s1 bigint", "head array<bigint>", "length int", "keep int"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            sizes, firsts, seconds, heads, keeps = [], [], [], [], []
            for t in batch.column(text).to_pylist():
                own = shingle_set(t)
                n, key = len(own), xxhash.xxh3_128_intdigest(own.tobytes())
                sizes.append(n)
                firsts.append((key >> 64) - (1 << 63))
                seconds.append((key & ((1 << 64) - 1)) - (1 << 63))
                heads.append(own[: head_length(n, percent)])
                keeps.append(own_allowed(n, percent) if n else 0)
            lengths = np.cumsum([0, *map(len, heads)], dtype=np.int32)
            flat = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(heads), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), flat,
                                                        pa.array([len(h) for h in heads], pa.int32()), pa.array(keeps, pa.int32())],
                names=[*others, "n", "s0", "s1", "head", "length", "keep"],
            )
        _WORDS.clear()  # the worker goes on to other tasks

    return docs.select(*[column(c) for c in others], text_or_empty(text).alias(text)).mapInArrow(run, schema)


def candidates(sketches: DataFrame) -> DataFrame:
    """node, s0, s1, n, first_id, central, tokens: distinct sets that may have a partner, with the tokens of which a partner keeps one too.

    Tokens travel with no more than the row they come from.
    """
    tokens = sketches.filter("n > 0").select("row", "s0", F.explode("head").alias("token"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("uses"), F.min("s0").alias("lo"), F.max("s0").alias("hi"))
    shared = save(counted.filter("lo <> hi").select("token", "uses"), "jaccard-shared")
    per_row = tokens.select("row", "token").join(shared, "token").groupBy("row").agg(F.collect_list(F.struct("uses", "token")).alias("shared"))
    allowed = F.col("keep") - (F.col("length") - F.size("shared"))
    kept = per_row.join(sketches.select("row", "doc_id", "s0", "s1", "n", "keep", "length"), "row").withColumn("allowed", allowed.cast("int")).filter("allowed > 0")
    chosen = F.transform(F.slice(F.sort_array("shared"), F.lit(1), F.col("allowed")), lambda x: x["token"])
    # Documents that use a token of the head, on average: the text that others were edited from shares more than any of them.
    uses = F.aggregate("shared", F.lit(0).cast("long"), lambda total, x: total + x["uses"])
    central = (uses + F.col("length") - F.size("shared")) / F.col("length")
    per_set = kept.select("s0", "s1", "n", "doc_id", central.alias("central"), chosen.alias("tokens")).groupBy("s0", "s1", "n").agg(
        F.min("doc_id").alias("first_id"), F.max("central").alias("central"), F.first("tokens").alias("tokens")
    )
    return save(per_set.select(F.monotonically_increasing_id().alias("node"), "s0", "s1", "n", "first_id", "central", "tokens"), "jaccard-candidates")


def distinct_groups(nodes: DataFrame) -> DataFrame:
    """node, n, central, token: the groups of nodes that share a kept token, each group once.

    Near copies share nearly all tokens, so most groups repeat each other. A group is known by its size and two 64-bit sums (xor)
    of independent hashes of its nodes; of the tokens with equal groups one is kept.
    """
    rows = nodes.select("node", "n", "central", F.explode("tokens").alias("token"))
    sums = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"x{i}") for i in (0, 1)]
    groups = rows.groupBy("token").agg(F.count("*").alias("size"), *sums).filter("size > 1")
    kept = save(groups.groupBy("size", "x0", "x1").agg(F.min("token").alias("token")).select("token"), "jaccard-tokens")
    return save(rows.join(kept, "token"), "jaccard-groups")


def sets_of(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """node, members, n, spare, bits: the whole set of every candidate node, its bitmap and how many tokens share bits with others."""
    wanted = nodes.select(F.col("first_id").alias("__first")).distinct()
    rows = docs.select(column("doc_id").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("__first")), "left_semi").select("text")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_):
            for t in batch.column(0).to_pylist():
                own = shingle_set(t)
                if len(own):
                    key, spots = xxhash.xxh3_128_intdigest(own.tobytes()), np.zeros(BITS, dtype=np.uint8)
                    spots[own.view(np.uint64) >> np.uint64(64 - BITS.bit_length() + 1)] = 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(key >> 64) - (1 << 63)], pa.int64()), pa.array([(key & ((1 << 64) - 1)) - (1 << 63)], pa.int64()),
                         pa.array([own], pa.list_(pa.int64())), pa.array([len(own) - int(spots.sum())], pa.int32()), pa.array([np.packbits(spots).tobytes()], pa.binary())],
                        names=["s0", "s1", "members", "spare", "bits"],
                    )
        _WORDS.clear()

    found = rows.mapInArrow(run, "s0 bigint, s1 bigint, members array<bigint>, spare int, bits binary")
    keyed = found.join(nodes.select("node", "s0", "s1", "n"), ["s0", "s1"])
    # Rows of one id, or rows without id, may repeat a set.
    return save(keyed.dropDuplicates(["node"]).select("node", "members", "n", "spare", "bits"), "jaccard-sets")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough, compared exactly."""
    of = lambda name: sets.select(F.col("node").alias(name), F.col("members").alias(f"m_{name}"))
    both = F.size(F.array_intersect("m_a", "m_b"))
    together = pairs.join(of("b"), "b").join(of("a"), "a")
    return together.withColumn("both", both).filter(100 * F.col("both") >= percent * (F.size("m_a") + F.size("m_b") - F.col("both"))).select("a", "b")


def components(edges: DataFrame, name: str = "jaccard-components") -> DataFrame:
    """node, comp: every node of an edge (a, b) with the smallest node that it reaches, by alternating large and small stars.

    Each round groups by one end and joins the minimum back, so no neighbourhood is collected. Rounds grow with the
    logarithm of the nodes.
    """
    edges, before = save(edges.select("a", "b").distinct(), name), None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(least.select("a", F.col("m").alias("b")))
        edges = save(small.distinct(), name)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(roots)
        before = state


def near_sizes(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def leader_pairs(rows: DataFrame, salt: int, percent: int) -> DataFrame:
    """For every node at most one pair with a leader of another component: of each token's nodes the most central one leads (salt 0), or the
    first in a pseudorandom order, and a node tries the leader that comes first of all its tokens'."""
    rank = F.struct((-F.col("central") if salt == 0 else F.lit(0.0)).alias("far"), F.xxhash64(F.lit(salt), "node").alias("hash"))
    leaders = rows.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("comp").alias("leader_comp"))).alias("l"))
    tried = rows.join(leaders, "token").filter((F.col("comp") != F.col("l.leader_comp")) & near_sizes("n", "l.leader_n", percent))
    best = tried.groupBy("node").agg(F.min("l").alias("l"))
    return best.select(F.least("node", "l.leader").alias("a"), F.greatest("node", "l.leader").alias("b")).distinct()


class SignatureTree:
    """Nodes of all levels over documents sorted by size: OR of bitmaps, range of sizes, most spare tokens, range of components.

    levels[0] are the documents, each level above joins FANOUT neighbours.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, spare: np.ndarray, bits: np.ndarray, comps: np.ndarray):
        order = np.lexsort((ids, bits[:, 0], comps, sizes))
        self.ids = ids[order]
        level = {"bits": bits[order], "low": sizes[order], "high": sizes[order], "spare": spare[order], "c_low": comps[order], "c_high": comps[order]}
        self.levels = [level]
        while len(level["low"]) > 1:
            cut = np.arange(0, len(level["low"]), FANOUT)
            over = {"bits": np.bitwise_or, "low": np.minimum, "high": np.maximum, "spare": np.maximum, "c_low": np.minimum, "c_high": np.maximum}
            level = {k: f.reduceat(level[k], cut, axis=0) for k, f in over.items()}
            self.levels.append(level)

    def possible(self, other: SignatureTree, depth_a: int, depth_b: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether documents below a pair of nodes may link and aren't connected.

        Common tokens are at most the common bits plus the tokens that share a bit with another one, and at most the smaller set.
        """
        x, y = self.levels[depth_a], other.levels[depth_b]
        fine = ~((x["c_low"][a] == x["c_high"][a]) & (y["c_low"][b] == y["c_high"][b]) & (x["c_low"][a] == y["c_low"][b]))
        fine &= (100 * x["high"][a] >= percent * y["low"][b]) & (100 * y["high"][b] >= percent * x["low"][a])
        at = np.flatnonzero(fine)
        i, j = a[at], b[at]
        most = np.bitwise_count(x["bits"][i] & y["bits"][j]).sum(axis=1, dtype=np.int64) + np.minimum(x["spare"][i], y["spare"][j])
        most = np.minimum(most, np.minimum(x["high"][i], y["high"][j]))
        fine[at] = (100 + percent) * most >= percent * (x["low"][i] + y["low"][j])
        return fine

    def pairs(self, other: SignatureTree, percent: int, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Traverses both trees together, from the roots down, `most` pairs of nodes at a time. With itself each pair comes once."""
        same = self is other
        top = max(len(self.levels), len(other.levels)) - 1
        work = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while work:
            depth, a, b = work.pop()
            da, db = min(depth, len(self.levels) - 1), min(depth, len(other.levels) - 1)
            fine = self.possible(other, da, db, a, b, percent)
            a, b = a[fine], b[fine]
            if not len(a):
                continue
            if depth == 0:
                yield self.ids[a], other.ids[b]
                continue
            a, grown_a = self.below(a, da, depth - 1, len(self.levels))
            b, grown_b = other.below(b, db, depth - 1, len(other.levels))
            left = np.repeat(a, grown_b, axis=1).ravel()
            right = np.tile(b, (1, grown_a)).ravel()
            inside = (left < len(self.levels[min(depth - 1, len(self.levels) - 1)]["low"])) & (right < len(other.levels[min(depth - 1, len(other.levels) - 1)]["low"]))
            if same:
                inside &= (left < right) if depth == 1 else (left <= right)
            left, right = left[inside], right[inside]
            for k in range(0, len(left), most):
                work.append((depth - 1, left[k : k + most], right[k : k + most]))

    @staticmethod
    def below(nodes: np.ndarray, depth: int, to: int, levels: int) -> tuple[np.ndarray, int]:
        """Children of nodes; a tree that is lower than the other stays at its root until the other has come down."""
        if depth == min(to, levels - 1):
            return nodes[:, None], 1
        return nodes[:, None] * FANOUT + np.arange(FANOUT), FANOUT


def families(rows: DataFrame, tree_rows: int, members: int = BLOCK_MEMBERS) -> DataFrame:
    """family, p, q, second, node, comp, kin: the places where nodes meet.

    The tokens whose least node is the same are a family; near copies share nearly all of theirs, so they meet in a few families, not under
    each token. The nodes of a family are cut into blocks of about `tree_rows` sets, or fewer where sets are long (`members` members); every two
    blocks meet at a place of their own (p, q), a node once for each other block. `kin` are all families of a node.
    """
    least = rows.groupBy("token").agg(F.min("node").alias("family"))
    own = save(rows.join(least, "token").select("family", "node", "n", "comp").distinct(), "jaccard-families")
    kin = own.groupBy("node").agg(F.sort_array(F.collect_list("family")).alias("kin"))
    parts = F.greatest(F.ceil(F.count("*") / tree_rows), F.ceil(F.sum("n") / members)).cast("int")
    sizes = own.groupBy("family").agg(F.count("*").alias("size"), parts.alias("blocks")).filter("size > 1").drop("size")
    split = own.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meeting = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return meeting.join(kin, "node").select(
        "family", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), (F.col("block") > F.col("other")).alias("second"), "node", "comp", "kin"
    )


def common_members(members: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 1 << 13, pairs: int = 8192) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, exactly: bitmaps over the members that two sets at least hold, `columns` of them at a time.

    An executor's workers do this at once, so little is held beside the sets: narrow bitmaps, and one order of the members.
    """
    both = np.zeros(len(left), dtype=np.int64)
    every = np.concatenate(members)
    order = np.argsort(every, kind="stable")
    every = every[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, dtype=np.int64)
    uses = np.diff(starts, append=len(every))
    del every, starts
    holder = np.repeat(np.arange(len(members), dtype=np.int32), [len(own) for own in members])[order][np.repeat(uses > 1, uses)]
    del order
    uses = uses[uses > 1]
    ends = np.cumsum(uses)
    for low in range(0, len(uses), columns):
        held = uses[low : low + columns]
        first = int(ends[low] - uses[low])
        spots = np.zeros((len(members), -(-len(held) // 64) * 64), dtype=bool)
        spots[holder[first : first + int(held.sum())], np.repeat(np.arange(len(held)), held)] = True
        bits = np.packbits(spots, axis=1).view(np.uint64)
        del spots
        for k in range(0, len(left), pairs):
            both[k : k + pairs] += np.bitwise_count(bits[left[k : k + pairs]] & bits[right[k : k + pairs]]).sum(axis=1, dtype=np.int64)
    return both


def first_meeting(family: int, kin: list[list[int]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of nodes share no lesser family: a pair counts in the least one that both belong to."""
    patterns: dict[tuple, int] = {}
    of = np.array([patterns.setdefault(tuple(f for f in own if f < family), len(patterns)) for own in kin], dtype=np.int64)
    lesser = [set(pattern) for pattern in patterns]
    code, back = np.unique(of[left] * len(lesser) + of[right], return_inverse=True)
    return np.array([lesser[c // len(lesser)].isdisjoint(lesser[c % len(lesser)]) for c in code.tolist()], dtype=bool)[back]


def least_reached(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that links lead to."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        for end in (left, right):
            np.minimum.at(label, before[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
        if (label[left] == label[right]).all() and (label == label[label]).all():
            break
    return label


def place_links(family: int, across: bool, rows: dict[str, list], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, root, n_links of the linked nodes of one place: its trees are traversed, what they leave is compared exactly, each link counts once."""
    n = len(rows["node"])
    sizes, spare, comps = (np.array(values, dtype=np.int64) for values in ([len(own) for own in rows["members"]], rows["spare"], rows["comp"]))
    bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint64).reshape(n, -1)
    tree = lambda at: SignatureTree(at, sizes[at], spare[at], bits[at], comps[at])
    second = np.array(rows["second"], dtype=bool)
    none = np.empty(0, dtype=np.int64)
    if not across:
        own = tree(np.arange(n))
        found = list(own.pairs(own, percent))
    elif second.all() or not second.any():
        return none, none, none
    else:
        found = list(tree(np.flatnonzero(~second)).pairs(tree(np.flatnonzero(second)), percent))
    if not found:
        return none, none, none
    left, right = (np.concatenate(ends) for ends in zip(*found, strict=True))
    once = first_meeting(family, rows["kin"], left, right)
    left, right = left[once], right[once]
    both = common_members(rows["members"], left, right)
    linked_ = 100 * both >= percent * (sizes[left] + sizes[right] - both)
    left, right = left[linked_], right[linked_]
    links = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
    at, node = np.flatnonzero(links), np.array(rows["node"], dtype=np.int64)
    return node[at], node[least_reached(n, left, right)[at]], links[at]


def family_links(rows: DataFrame, sets: DataFrame, percent: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """a, b, n_links: per place and linked node a, a node b that links of the place lead to, and how many links a has there.

    All links between different components of `rows` (node, n, comp, token) are met, each at one place; links never leave their task, only sums and
    at most one edge for each node do.
    """
    place = ["family", "p", "q"]
    held = ["second", "node", "comp", "kin", "spare", "bits"]
    full = families(rows, tree_rows).join(sets.select("node", "members", "spare", "bits"), "node").select(*place, *held, "members")
    full = full.repartition(*place).sortWithinPartitions(*place)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places() -> Iterator[tuple[list, dict[str, list]]]:
            key, own = None, {}
            for frame in frames:
                keys = np.stack([frame.column(c).to_numpy() for c in place], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for at, end in zip(cuts, cuts[1:]):  # noqa: B905
                    if at == end:
                        continue
                    if keys[at].tolist() != key:
                        if own:
                            yield key, own
                        key, own = keys[at].tolist(), {c: [] for c in (*held, "members")}
                    part = frame.slice(at, end - at)
                    for c in held:
                        own[c] += part.column(c).to_pylist()
                    own["members"] += [row.values.to_numpy().copy() for row in part.column("members")]
            if own:
                yield key, own

        for (family, p, q), own in places():
            a, b, n = place_links(family, p != q, own, percent)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n_links"])

    return full.mapInArrow(run, "a bigint, b bigint, n_links bigint")


def jaccard_components(docs: DataFrame, text: str = "text", percent: int = PERCENT, rounds: int = 0, tree_rows: int = TREE_ROWS, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`, and with `links` n_links, the number of other distinct sets that the row's set links to.

    component_id is the smallest doc_id that is reached by links (copies are linked). Texts without words, NULL ones too, have no
    shingles and are linked with nothing: their component is their own id. Rows without id take part; where all rows of a
    component have none, component_id is NULL. Repeated rows repeat.

    The trees meet every link. `rounds` of links to leaders before them leave less to the trees where only components are wanted;
    with `links` there are none.
    """
    sketches = save(sketched(docs.select("doc_id", column(text).alias("text")), "text", percent).withColumn("row", F.monotonically_increasing_id()), "jaccard-sketches")
    nodes = candidates(sketches)
    sets = sets_of(docs, nodes, text)
    rows = distinct_groups(nodes)
    comps = nodes.select("node", F.col("node").alias("comp"))

    def with_comps() -> DataFrame:
        """Rows of the tokens whose nodes lie in several components."""
        own = rows.join(comps, "node")
        mixed = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
        return save(own.join(mixed, "token", "left_semi"), "jaccard-rows")

    def joined(more: DataFrame) -> DataFrame:
        """Components after more links: each link counts as one between the components of its ends, however many nodes they have."""
        side = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        ends = more.join(side("a"), "a").join(side("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
        found = components(ends.filter("a <> b")).select(F.col("node").alias("comp"), F.col("comp").alias("joined"))
        return save(comps.join(found, "comp", "left").select("node", F.coalesce("joined", "comp").alias("comp")), "jaccard-comps")

    left = with_comps() if rounds and not links else rows.withColumn("comp", F.col("node"))
    for salt in range(0 if links else rounds):
        if left.isEmpty():
            break
        more = save(linked(leader_pairs(left, salt, percent), sets, percent), "jaccard-links")
        if more.isEmpty():
            break
        comps = joined(more)
        left = with_comps()
    found = save(family_links(left, sets, percent, tree_rows), "jaccard-links")
    more = found.filter("a <> b").select("a", "b")
    if not more.isEmpty():
        comps = joined(more)
    placed = nodes.join(comps, "node")
    least = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    smallest = placed.join(least, "comp")
    if links:
        degrees = found.groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("n_links"))
        smallest = smallest.join(degrees, "node", "left")
    else:
        smallest = smallest.withColumn("n_links", F.lit(0))
    per_set = sketches.filter("n > 0").groupBy("s0", "s1").agg(F.min("doc_id").alias("own_first"))
    per_set = per_set.join(smallest.select("s0", "s1", "component_id", "n_links"), ["s0", "s1"], "left").select("s0", "s1", F.coalesce("component_id", "own_first").alias("component_id"), "n_links")
    return sketches.join(per_set, ["s0", "s1"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *[F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] * links,
    )


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is their component's, all columns. Rows without id stay; rows that repeat an id stay or go together."""
    found = jaccard_components(docs.select(column(key).alias("doc_id"), column(text).alias("text")))
    gone = save(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "jaccard-gone")
    return docs.join(gone, column(key) == F.col("__gone"), "left_anti")


def op9_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(prepare(spark), sf_dir, "documents").select("doc_id", "text"), links=True)
