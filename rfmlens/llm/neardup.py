"""Near-duplicate groups of documents: MinHash with banding, verified on full shingle sets.

1. Every text becomes its set of distinct word shingles (64-bit hashes), a 64-bit fingerprint of the set and the minima of
   ``BANDS * ROWS`` universal hash functions. Texts with one set are one node from here on.
2. The minima are cut into bands; nodes that agree on a band share a bucket. Two sets of similarity 0.8 miss each other in all 36
   bands of 5 with a probability below 10^-6.
3. A bucket of m nodes isn't expanded into its pairs. Its hub, the node that shares most buckets with others, is paired with the m - 1
   others; pairs whose signatures agree too little are dropped, the others are confirmed on full sets.
4. Confirmed links are joined into components by alternating large-star and small-star.
5. Where a bucket still holds several components, the nodes outside of its largest one are compared with the
   largest one and with each other, once for all buckets that have the same largest one. Their sets meet in blocks of bounded size,
   which verify signatures, confirm on full sets and emit links alone. So no pair that shares a bucket is left out
   unless it is connected already. The components are then joined anew.

No step collects links, and no key with many rows meets in one task: sums combine before the shuffle, and rows of
a key are joined by ``common.lookup``, as plain tables that AQE splits, or in salted chunks. Tables that are read twice are written to the shared folder.

Cases: null or blank texts have no shingles and are linked with nothing; a text with fewer words than a shingle is one shingle;
repeated rows and texts with one set are copies; a null id takes part in links but is never the smallest, so its component is null
only if no id is reachable, and it is then kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.llm.common import cut_lineage, lookup, unused

BANDS, ROWS = 36, 5
#: The signature by which pairs are verified first: the lower halves of all minima, of which so many must agree. Of 180, sets of
#: similarity 0.8 agree on fewer than 114 with a probability below 10^-6.
SIGNATURE, AGREE = BANDS * ROWS, 114
#: Nodes of a bucket that meet in a block, and shingles of the sets that meet in one.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Texts wanted for confirmation are named to all tasks if they are at most so many rows of five numbers, else by a shuffle.
BROADCAST_ROWS = 200_000
FACTORS = np.random.default_rng(20240229).integers(1 << 16, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * M2
    return x ^ x >> np.uint64(29)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``size`` words, A-Z in lower case."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h * M1 + w[j:len(w) - k + 1 + j])
    return np.unique(h)


def minima(s: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function ``x -> factor * x mod 2^32`` on a set that isn't empty."""
    x = (s ^ s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 512):
        np.minimum(out, (FACTORS[:, None] * x[None, a:a + 512]).min(axis=1), out=out)
    return out


def bands(m: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        h = _mix(h * M1 + m[j::ROWS])
    return h.view(np.int64)


def signature(m: np.ndarray) -> bytes:
    return m.astype(np.uint16).tobytes()


def name_of(s: np.ndarray) -> int:
    """Fingerprint of a set."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def sketch(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version (hash of the text), n (size of the set), node (null where it is empty), bands, signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 1000) for a in range(0, batch.num_rows, 1000)):
                n, node, band, sign = [], [], [], []
                for t in part.column("text").to_pylist():
                    s = shingles(t, size)
                    m = minima(s) if len(s) else None
                    n.append(len(s))
                    node.append(name_of(s) if len(s) else None)
                    band.append(bands(m) if len(s) else None)
                    sign.append(signature(m) if len(s) else None)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "version": part.column("version"), "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64()),
                    "bands": pa.array(band, pa.list_(pa.int64())), "signature": pa.array(sign, pa.binary())})

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, version long, n long, node long, bands array<long>, signature binary")


def buckets(nodes: DataFrame) -> DataFrame:
    """h, node, size (nodes) and hub of buckets with several nodes, from node and bands of each node; staged."""
    rows = nodes.select(F.explode(F.array_distinct("bands")).alias("h"), "node")
    sizes = cut_lineage(rows.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    # both sides of these joins are plain tables, so AQE splits the partition of a hot bucket
    members = cut_lineage(rows.join(sizes, "h"), "members")
    degree = members.groupBy("node").agg(F.sum(F.col("size") - 1).alias("degree"))  # a node is in BANDS buckets at most
    hubs = cut_lineage(members.join(degree, "node").groupBy("h").agg(
        F.max_by("node", F.struct("degree", "node")).alias("hub")), "hubs")
    return cut_lineage(members.join(hubs, "h"), "buckets")


def agree(a: pd.Series, b: pd.Series) -> pd.Series:
    """Do two signatures agree enough?"""
    p, q = (np.frombuffer(b"".join(v), np.uint16).reshape(len(v), SIGNATURE) for v in (a, b))
    return pd.Series((p == q).sum(axis=1) >= AGREE, dtype=bool)


def alike(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose signatures agree enough; ``a`` may occur in many."""
    pairs = cut_lineage(pairs, "candidates")
    often = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    often = cut_lineage(often.join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a"), "often")
    with_a = lookup(pairs, often, ["a"], "k", pairs.count(), F.col("b"))
    return with_a.join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b").where(F.pandas_udf(agree, "boolean")("sa", "sb")).select("a", "b")


def with_texts(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` with the text of its doc_id and version; one text's rows come together."""
    wanted = cut_lineage(wanted, "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = _texts(docs, id_col, text_col)
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["version"] == wanted["version"])
    return rows.join(wanted, same).drop("doc_id", "version")


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches and the set of each row's text."""
    before, s = None, np.zeros(0, np.uint64)
    for batch in batches:
        for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
            found = []
            for t in part.column("text").to_pylist():
                if before is None or t != before:
                    before, s = t, shingles(t, size)
                found.append(s)
            yield part, found


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Do two sorted sets reach the similarity?"""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose full sets reach the similarity; ``a`` may occur in many."""
    sized = cut_lineage(pairs.join(nodes.select(F.col("node").alias("b"), "doc_id", "version", "n"), "b"), "sized-pairs")
    # pairs of one ``a`` are dealt into chunks of about BLOCK nodes or BLOCK_SHINGLES, whichever is less
    load = cut_lineage(sized.groupBy("a").agg(F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK))).alias("chunks"),
                                              F.count(F.lit(1)).alias("k")), "load")
    others = lookup(sized, load, ["a"], "k", sized.count(), F.col("b")).select(
        "doc_id", "version", "a", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"), F.col("b").alias("other"))
    own = load.join(nodes.select(F.col("node").alias("a"), "doc_id", "version"), "a").select(
        "doc_id", "version", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("other"))
    rows = with_texts(others.unionByName(own), docs, id_col, text_col)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _sets(batches, size):
            yield pa.RecordBatch.from_pydict({"a": part.column("a"), "chunk": part.column("chunk"), "other": part.column("other"),
                                              "s": pa.array([x.tobytes() for x in found], pa.binary())})

    def meet(x: pa.Table) -> pa.Table:
        x = x.combine_chunks()
        other, s = x["other"].to_pylist(), x["s"]
        read = lambda k: np.frombuffer(s[k].as_buffer(), np.uint64)
        mine = next((read(k) for k, b in enumerate(other) if b is None), None)
        hits = set()
        for k, b in enumerate(other):
            if b is not None and mine is not None and b not in hits and similar(mine, read(k), percent):
                hits.add(b)
        return pa.table({"a": pa.array([x["a"][0].as_py()] * len(hits), pa.int64()), "b": pa.array(sorted(hits), pa.int64())})

    return rows.mapInArrow(sets, "a long, chunk long, other long, s binary").groupBy("a", "chunk").applyInArrow(meet, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of all nodes that have links, by alternating large-star and small-star."""
    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Large: a node's larger neighbours are linked to its smallest one; small: its smaller neighbours, and itself."""
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"), F.count(F.lit(1)).alias("k")), "low")
        total = low.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
        near = lookup(both, low, ["u"], "k", total, F.col("v"))
        if large:
            out = near.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        else:
            out = near.select(F.col("v").alias("a"), F.col("low").alias("b")).union(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
        return cut_lineage(out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = cut_lineage(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now = state(edges)
    while True:
        edges, before = star(star(edges, True), False), now
        now = state(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def open_rows(members: DataFrame, labels: DataFrame) -> DataFrame:
    """unit, node, label, open: what has to meet after the hubs.

    A unit is the largest component of some bucket that holds several; its rows are the nodes outside of it
    that share such a bucket (open) and its own nodes.
    """
    rows = members.where("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = cut_lineage(rows.select("h", "node", "label"), "labelled")
    per = rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(
        F.max_by("label", F.struct("k", "label")).alias("unit"), F.count(F.lit(1)).alias("parts"))
    still = cut_lineage(per.where("parts > 1").drop("parts"), "open-buckets")
    out = rows.join(still, "h").where("label != unit")
    out = cut_lineage(out.select("unit", "node", "label").distinct().withColumn("open", F.lit(True)), "open")
    units = cut_lineage(out.select(F.col("unit").alias("label")).distinct(), "units")
    own = rows.select("node", "label").distinct().join(units, "label", "left_semi")
    # nodes of a unit in no open bucket of three share none with its open nodes
    return out.unionByName(own.select(F.col("label").alias("unit"), "node", "label", F.lit(False).alias("open")))


def confirm_open(rows: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) by which the open nodes of each unit join its own nodes or each other.

    Blocks of nodes meet; a pair whose nodes were connected by an earlier link of the same block is skipped.
    """
    rows = cut_lineage(rows.join(nodes.select("node", "doc_id", "version", "n"), "node"), "open-nodes")
    per = rows.groupBy("unit").agg(*[F.greatest(F.ceil(F.count(F.when(c, 1)) / F.lit(BLOCK)), F.ceil(F.sum(F.when(c, F.col("n"))) / F.lit(BLOCK_SHINGLES)),
                                                F.lit(1)).cast("long").alias(name) for name, c in (("xs", F.col("open")), ("ys", F.lit(True)))],
                                   F.count(F.lit(1)).alias("k"))
    per = cut_lineage(per, "unit-blocks")
    rows = lookup(rows, per, ["unit"], "k", rows.count(), F.col("node"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    cols = ["doc_id", "version", "unit", "x", "y", "left", "node", "label", "open"]
    left = rows.where("open").withColumn("x", own("xs")).withColumn("y", every("ys")).withColumn("left", F.lit(True)).select(*cols)
    right = rows.withColumn("y", own("ys")).withColumn("x", every("xs")).withColumn("left", F.lit(False)).select(*cols)
    texts = with_texts(left.unionByName(right), docs, id_col, text_col)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, sign = None, b""
        for part, found in _sets(batches, size):
            signs = []
            for s in found:
                if s is not before:
                    before, sign = s, signature(minima(s))
                signs.append(sign)
            yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in cols[2:]}, "signature": pa.array(signs, pa.binary()),
                                              "s": pa.array([s.tobytes() for s in found], pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = t["left"].to_numpy()
        p, q = np.flatnonzero(side), np.flatnonzero(~side)
        node, label, is_open = (t[c].to_numpy() for c in ("node", "label", "open"))
        sign = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint16).reshape(len(t), SIGNATURE)
        same = np.zeros((len(p), len(q)), np.uint8)
        for k in range(SIGNATURE):
            same += sign[p, k, None] == sign[None, q, k]
        # of two open nodes, the smaller is left once
        ok = (same >= AGREE) & (label[p][:, None] != label[q][None, :]) & (~is_open[q][None, :] | (node[p][:, None] < node[q][None, :]))
        i, j = np.nonzero(ok)
        order = np.lexsort((node[q[j]], node[p[i]], -same[i, j].astype(int)))
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        s, links = t["s"], []
        for a, b in zip(p[i[order]].tolist(), q[j[order]].tolist(), strict=True):
            x, y = root(int(label[a])), root(int(label[b]))
            if x != y and similar(np.frombuffer(s[a].as_buffer(), np.uint64), np.frombuffer(s[b].as_buffer(), np.uint64), percent):
                up[x] = y
                links.append((int(node[a]), int(node[b])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return texts.mapInArrow(sets, "unit long, x long, y long, left boolean, node long, label long, open boolean, signature binary, s binary").groupBy(
        "unit", "x", "y").applyInArrow(meet, "a long, b long")


def groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version, n_shingles, component_id, kept and group (a number for each component, null without shingles) of every row.

    Sets of shingles are linked if ``100 * intersection >= percent * union``.
    """
    args = dict(docs=docs, size=size, percent=percent, id_col=id_col, text_col=text_col)
    rows = cut_lineage(sketch(docs, size, id_col, text_col), "sketches")
    nodes = cut_lineage(rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.struct("doc_id", "version")).alias("r"), F.min("doc_id").alias("low"), F.first("n").alias("n"), F.count(F.lit(1)).alias("k")).select(
        "node", "r.*", "low", "n", "k"), "nodes")
    # copies have one sketch: the first of each set, before any join, so that large groups of copies count once
    sketches = cut_lineage(rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.first("bands").alias("bands"), F.first("signature").alias("signature")), "node-sketches")
    members = buckets(sketches.select("node", "bands"))
    named = members.select("node").distinct()
    signatures = cut_lineage(sketches.select("node", "signature").join(named, "node", "left_semi"), "signatures")
    stars = members.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = cut_lineage(confirm(alike(stars, signatures), nodes=nodes, **args), "links")
    labels = cut_lineage(components(links), "labels")
    more = cut_lineage(confirm_open(open_rows(members, labels), nodes=nodes, **args), "links")
    if more.head(1):
        labels = cut_lineage(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)), "labels")
    # the smallest id of each component, and of each set with copies
    part = nodes.select("node", "low", "k").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    part = cut_lineage(part, "parts")
    low = cut_lineage(part.groupBy("label").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("k"), F.sum("k").alias("rows")).where("rows > 1").drop("rows"), "lows")
    ids = lookup(part.select("node", "label", F.col("k").alias("copies")), low, ["label"], "k", part.count(), F.col("node"))
    ids = ids.where("copies > 1 or label != node or component_id is not null")
    ids = cut_lineage(ids.select("node", "label", "component_id", F.col("copies").alias("k")), "components")
    out = lookup(rows.select("doc_id", "version", "n", "node"), ids, ["node"], "k", rows.count(), F.struct("doc_id", "version"))
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "version", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                      F.coalesce("label", "node").alias("group"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id (then of the smallest hash of the text); texts without shingles stay."""
    rows = cut_lineage(groups(docs, size, percent, id_col, text_col).where("group is not null").select("doc_id", "version", "group"), "groups")
    first = cut_lineage(rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version")).alias("r"),
                                                  F.count(F.lit(1)).alias("k")).where("k > 1"), "firsts")
    near = lookup(rows, first, ["group"], "k", rows.count(), F.struct("doc_id", "version")).where("r is not null")
    same = F.col("doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("version") == F.col("r.version"))
    own_id, version = unused(docs, "near_id"), unused(docs, "near_version")
    near = cut_lineage(near.select(F.col("doc_id").alias(own_id), F.col("version").alias(version), same.alias("stays")), "decisions")
    drop = near.where("not stays").select(own_id, version).distinct()
    repeated = near.where("stays").groupBy(own_id, version).agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    here = [F.col(id_col).cast("long").eqNullSafe(F.col(own_id)), F.xxhash64(F.col(text_col).cast("string")) == F.col(version)]
    drop = cut_lineage(drop, "drop")
    out = docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, here, "left_anti")
    repeated = cut_lineage(repeated, "repeated")
    if repeated.head(1):  # rows that share id and text: one of them stays
        again = out.join(repeated, here, "left_semi").dropDuplicates([id_col, text_col])
        out = out.join(repeated, here, "left_anti").unionByName(again)
    return out


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all whole texts of ``documents`` under links of at least 0.8 on two-word shingles."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2).drop("version", "group")
