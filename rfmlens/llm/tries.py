"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

Sequences. A turn is the 16-byte digest of its role and text, a conversation the bytes of its turns' digests one after another; so
byte order keeps conversations with a common prefix together, and the depth of the prefix of two of them is their common bytes by 16.
The texts don't move beyond their turn's row.

Forests. All conversations are sorted over ranges; each range is cut into blocks. In a block, neighbours are edges, which
are taken in descending order of their common depth: joining two components makes the branching node of that depth, or adds to
it where a component already has its node there. Depths between a node and the one above it are nodes of the same members. A node none of whose
members has a common prefix of its depth with the rows next to the block is final. The others, on the prefixes that a block
shares with its neighbours, are contracted to one row of sums for each block: members, children and turns that begin in the block, leaves
that end there. Sums of the same prefix are added across blocks, and nodes below them get their parent's smallest member by a join that
is safe for parents with very many children (``common.lookup``).

Ends. Ids of the conversations that end in a node are written as text in blocks; those of a node that spans blocks are put together in order by one
stream, piece by piece (a SHA-256 can't be put together otherwise), without holding them.

Cases: null turns come first, ties in turn are ordered by role and digest; null roles and texts are empty; repeated rows are turns of their own; rows without a
conv_id belong to no conversation and are left out; a conversation that isn't there gives no prefix; an empty table has no nodes; other columns
are ignored. A conversation is one row of 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rfmlens.llm.common import cut_lineage, lookup
from rfmlens.operators.order import in_ranges

WIDTH = 16
#: Turns and conversations of a block.
BLOCK = 200_000
#: Ids that are written as one piece of text.
PIECE = 2_000
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, final boolean"
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = 5, spread: int = 9) -> DataFrame:
    """conv_id, seq (digests) and sizes (UTF-8 bytes of the texts) of every rebuilt conversation: the first h turns of the
    conversation ``c - c % family``, then its own after its first h, where h is the CRC-32 of c modulo ``spread``."""
    said, told = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, told), 256).substr(1, 2 * WIDTH)
    c = F.col("conv_id")
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), (F.col(conv).cast("long") - F.col(conv).cast("long") % family).alias("first_id"),
        F.struct(F.col(turn).cast("long").alias("turn"), said.alias("role"), digest.alias("d"), F.octet_length(told).cast("long").alias("b")).alias("t"))
    own = rows.repartition("first_id").groupBy("first_id", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = F.max(F.when(c == F.col("first_id"), F.slice("ts", 1, spread))).over(Window.partitionBy("first_id"))
    h = (F.crc32(c.cast("string")) % spread).cast("int")
    empty = F.slice("ts", 1, 0)
    own = own.withColumn("head", F.coalesce(head, empty)).withColumn("h", h)
    whole = own.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("ts", F.col("h") + 1, F.size("ts"))).alias("ts"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("ts", lambda t: t["d"]), "")).alias("seq"), F.transform("ts", lambda t: t["b"]).alias("sizes"))


def common(a: bytes, b: bytes) -> int:
    """Turns at the beginning of both."""
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    low, high = 0, n  # the first low turns agree, the first high don't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * WIDTH:mid * WIDTH] == b[low * WIDTH:mid * WIDTH] else (low, mid)
    return low


@dataclass
class Node:
    """A branching or ending node; lo, hi: its rows in the block."""

    depth: int
    lo: int
    hi: int
    conv: int
    leaves: int
    saved: int = 0
    children: list[Node] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)


class Forest:
    """The nodes of sorted rows; left and right: common depth with the row before and after them, -1 where there is none."""

    def __init__(self, convs: list[int], seqs: list[bytes], sizes: list[list[int]], left: int, right: int):
        self.convs, self.seqs, self.left, self.right = convs, seqs, left, right
        self.sums = [list(accumulate(s, initial=0)) for s in sizes]
        self.length = [len(s) // WIDTH for s in seqs]
        n = len(convs)
        self.last = n - 1
        lcp = [common(seqs[i], seqs[i + 1]) for i in range(n - 1)]
        after = [*lcp, right]
        self.top = [Node(self.length[i], i, i, convs[i], int(after[i] < self.length[i]), ends=[i]) for i in range(n)]
        self.above = list(range(n))
        for i in sorted(range(n - 1), key=lcp.__getitem__, reverse=True):
            self.merge(i, i + 1, lcp[i])
        self.root = self.top[self.find(0)]

    def find(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = i = self.above[self.above[i]]
        return i

    def at_depth(self, node: Node, depth: int) -> Node:
        """The node itself if it is at ``depth``, else one above it there."""
        if node.depth == depth:
            return node
        up = Node(depth, node.lo, node.hi, node.conv, node.leaves, children=[node])
        up.saved = node.saved + self.chain(node, depth)
        return up

    def begins(self, node: Node, depth: int) -> bool:
        return node.lo > 0 or depth > self.left

    def chain(self, node: Node, above: int) -> int:
        """What the node's turns deeper than ``above`` save: every member's bytes but one's, which the block where it begins leaves out."""
        c, n = self.sums[node.lo], node.hi - node.lo + 1
        total = n * (c[node.depth] - c[above])
        new = above if node.lo > 0 else max(above, min(self.left, node.depth))
        return total - (c[node.depth] - c[new])

    def merge(self, i: int, j: int, depth: int) -> None:
        i, j = self.find(i), self.find(j)
        a, b = self.at_depth(self.top[i], depth), self.at_depth(self.top[j], depth)
        if len(a.children) + len(a.ends) < len(b.children) + len(b.ends):
            a.children, b.children, a.ends, b.ends = b.children, a.children, b.ends, a.ends
        a.children += b.children
        a.ends += b.ends
        a.lo, a.hi, a.conv = min(a.lo, b.lo), max(a.hi, b.hi), min(a.conv, b.conv)
        a.leaves += b.leaves
        a.saved += b.saved
        self.above[j] = i
        self.top[i] = a

    def shared(self, node: Node, depth: int) -> bool:
        return node.lo == 0 and depth <= self.left or node.hi == self.last and depth <= self.right

    def keys(self) -> dict[tuple[int, int], bytes]:
        """Digests of the prefixes that are shared with rows outside, by (0 for the first row or 1 for the last, depth)."""
        out = {}
        for side, i, most in ((0, 0, self.left), (1, self.last, self.right)):
            h = hashlib.sha256()
            for d in range(most + 1):
                if d:
                    h.update(self.seqs[i][(d - 1) * WIDTH:d * WIDTH])
                out[side, d] = h.copy().digest()
        return out

    def rows(self) -> Iterator[tuple]:
        """Rows of ``NODE``, and for nodes that are shared and have ends their ids in order."""
        keys = self.keys()
        key = lambda node, d: keys[0, d] if node.lo == 0 and d <= self.left else keys[1, d]
        stack: list[tuple[Node, Node | None]] = [(self.root, None)]
        while stack:
            node, up = stack.pop()
            above = up.depth if up else -1
            cum, n = self.sums[node.lo], node.hi - node.lo + 1
            ids = sorted(self.convs[i] for i in node.ends)
            saved = node.saved
            for d in range(node.depth, above, -1):
                mine = self.shared(node, d)
                own = (n * (cum[d] - cum[d - 1]) - (cum[d] - cum[d - 1] if self.begins(node, d) else 0)) if d else 0
                saved += own
                below = sum(self.begins(c, d + 1) for c in node.children) if d == node.depth else int(self.begins(node, d + 1))
                owner = up if d - 1 == above else node
                by_key = d > 0 and self.shared(owner, d - 1)
                parent = None if d == 0 or by_key else owner.conv
                ends = ids if d == node.depth else []
                yield (key(node, d) if mine else None, key(owner, d - 1) if by_key else None, node.conv, d, parent, n, below, node.leaves, saved,
                       None if mine else hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else NOTHING, not mine), ends if mine else []
            stack += [(c, node) for c in node.children]


def nodes(sorted_rows: DataFrame, edges: dict[int, tuple[int, int]], block: int = BLOCK) -> DataFrame:
    """Rows of ``NODE`` and, with a null depth, pieces of ids: key, conv_id (the first of the piece), ends_sha256 (the ids as text)."""
    told = sorted_rows.sparkSession.sparkContext.broadcast(edges)
    n = sorted_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    names = [c.split()[0] for c in NODE.split(", ")]
    types = [{"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in NODE.split(", ")]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turns, left, part = 0, -1, None

        def out(right: int) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            convs, seqs, sizes = (list(c) for c in zip(*held, strict=True))
            for row, ends in Forest(convs, seqs, sizes, left, right).rows():
                rows.append(row)
                for a in range(0, len(ends), PIECE):
                    some = ends[a:a + PIECE]
                    rows.append((row[0], None, some[0], None, None, len(some), None, None, None, ",".join(map(str, some)), False))
                if len(rows) >= 10_000:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)

        for batch in batches:
            for p, conv, seq, size in zip(*(batch.column(c).to_pylist() for c in ("__p", "conv_id", "seq", "sizes")), strict=True):
                if held and p != part:
                    yield from out(told.value[part][1])
                    held, turns = [], 0
                elif held and turns >= block:
                    right = common(held[-1][1], seq)
                    yield from out(right)
                    held, turns, left = [], 0, right
                if p != part:
                    part, left = p, told.value[p][0]
                held.append((conv, seq, size))
                turns += len(size) + 1
        if held:
            yield from out(told.value[part][1])

    whole = sorted_rows.repartitionById(int(n), "__p").sortWithinPartitions("__p", "__i")
    return whole.select("__p", "conv_id", "seq", "sizes").mapInArrow(run, NODE)


def neighbours(sorted_rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Common depth of each range's first row with the row before it, and of its last row with the row after it (-1 where there is none)."""
    ends = cut_lineage(sorted_rows.groupBy("__p").agg(F.min_by("seq", "__i").alias("a"), F.max_by("seq", "__i").alias("z")), "trie-ranges")
    parts = sorted(r[0] for r in ends.select("__p").collect())
    pairs = ends.sparkSession.createDataFrame(list(zip(parts, parts[1:])), "__p int, __q int")
    nxt = ends.select(F.col("__p").alias("__q"), F.col("a").alias("b"))
    both = (F.least(F.octet_length("z"), F.octet_length("b")) / WIDTH).cast("int")
    turn = lambda c, i: F.substring(c, (i - 1) * WIDTH + 1, F.lit(WIDTH))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), lambda i: turn("z", i) != turn("b", i))
    depth = F.least(F.coalesce(F.get(differ, 0) - 1, both), both)
    met = {r[0]: (r[1], r[2]) for r in ends.join(pairs, "__p").join(nxt, "__q").select("__p", "__q", depth).collect()}  # a row a range
    before = {q: d for q, d in met.values()}
    return {p: (before.get(p, -1), met[p][1] if p in met else -1) for p in parts}


def put_together(pieces: DataFrame) -> DataFrame:
    """key and ends_sha256 of the ids whose pieces (key, conv_id, ids) are given; one stream a key in ascending order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if h:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
        if h:
            done.append((key, h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["key", "ends"])

    return pieces.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInArrow(run, "key binary, ends string")


def trie(seqs: DataFrame, block: int = BLOCK, ranges: int | None = None) -> DataFrame:
    """A row for each node: ``OUT``. ``seqs`` has conv_id, seq and sizes, as ``sequences`` gives them."""
    placed = in_ranges(seqs, ["seq", "conv_id"], ranges, "trie-sorted")
    made = cut_lineage(nodes(placed, neighbours(placed), block), "trie-nodes")
    final = made.where(F.col("final") & F.col("parent_key").isNull())
    shared = made.where(~F.col("final") & F.col("depth").isNotNull()).groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    ends = put_together(made.where(F.col("depth").isNull()).select("key", "conv_id", F.col("ends_sha256").alias("ids")))
    shared = cut_lineage(shared.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))), "trie-shared")
    top = shared.where("depth = 0").select(F.lit(None).cast("long").alias("parent_conv_id"), *[c for c in OUT if c != "parent_conv_id"])
    columns = ["parent_key", *[c for c in OUT if c != "parent_conv_id"]]
    below = made.where(F.col("final") & F.col("parent_key").isNotNull()).select(*columns).unionByName(shared.where("depth > 0").select(*columns))
    n = below.groupBy("parent_key").agg(F.count(F.lit(1)).alias("n"))
    parents = cut_lineage(n.join(shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key"), "trie-parents")
    total = parents.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    below = lookup(below, parents, ["parent_key"], "n", total, F.hash("conv_id", "depth"))
    return final.select(*OUT).unionByName(top.select(*OUT)).unionByName(below.select(*OUT))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations of ``conversations``."""
    return trie(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
