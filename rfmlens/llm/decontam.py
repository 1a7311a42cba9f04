"""Benchmark decontamination: size-partitioned MinHash containment search.

A benchmark item is short and may lie anywhere in a long document, so documents aren't sketched: the similarity of a
long document's signature to a short item's is close to nothing, however well the item is contained. Instead
the items are sketched by their minima and the documents' shingles are looked up in the sketches. Items
are partitioned by size: within the partition of sizes up to u, an item keeps its ``floor((1 - threshold) * u) + 1``
smallest shingle hashes. A document that holds at least ``threshold`` of an item's shingles lacks too few of
them to lack all of these minima, so every such pair becomes a candidate: no pair is lost. Candidates are then verified
on all shingles of both texts.

Words are lower-cased runs of other characters than white space; a shingle is ``size`` words in a row, and a
shorter item has all of its words as its one shingle (looked for among the documents' shingles of that many words).
Shingles are compared by their 64-bit hash.

Only DataFrame functions run on the executors. The items' shingles are broadcast if they are at most ``BROADCAST_ROWS``
rows of three numbers, and joined by a shuffle otherwise.

Cases: null or blank texts have no shingles and match nothing, and so do items without words; different texts under one id
are different documents or items, and repeated rows are one; a null id is an id; ``find_leaks`` ignores other columns and
``drop_leaks`` keeps them and all clean rows as they are; empty tables give no pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.llm.common import cut_lineage, unused

SIZE = 5
THRESHOLD = 0.8
#: Upper sizes of the partitions are powers of this.
GROWTH = 1.25
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int | Column) -> Column:
    """The 64-bit hash of every ``size`` words in a row; none where there are fewer words."""
    starts = F.sequence(F.lit(1), F.size(words) - size + 1)
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(
        F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, size))))


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE,
                  threshold: float = THRESHOLD) -> DataFrame:
    """item_id, item_version, width (words in a shingle), n (distinct shingles of the item), h, minimum (is h in its sketch)."""
    w = words_of(F.col(text_col).cast("string"))
    s = items.select(F.col(id_col).cast("long").alias("item_id"), w.alias("w")).where(F.size("w") > 0).withColumn(
        "width", F.least(F.size("w"), F.lit(size)))
    s = s.select("item_id", "width", F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), F.col("width")))).alias("hs"))
    s = s.distinct().withColumn("n", F.size("hs").cast("long"))
    step = F.lit(float(GROWTH))
    upper = F.greatest(F.floor(F.pow(step, F.ceil(F.log(F.col("n").cast("double")) / F.log(step)))), F.col("n"))
    s = s.withColumn("keep", F.floor((1 - threshold) * upper + 1e-9) + 1)
    return s.select("item_id", F.xxhash64("hs").alias("item_version"), "width", "n", "keep", F.posexplode("hs").alias("at", "h")).select(
        "item_id", "item_version", "width", "n", "h", (F.col("at") < F.col("keep")).alias("minimum"))


def _shingles(texts: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, version, h: a row for each shingle of each width."""
    parts = [shingle_hashes(F.col("words"), k) for k in widths]
    return texts.select("doc_id", "version", words_of(F.col("text")).alias("words")).select(
        "doc_id", "version", F.explode(parts[0] if len(parts) == 1 else F.concat(*parts)).alias("h"))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs that reach ``threshold``: doc_id, version (hash of the text), item_id, n_shingles, n_found, containment."""
    table = cut_lineage(item_shingles(items, item_col, item_text_col, size, threshold), "items")
    widths = sorted(r[0] for r in table.select("width").distinct().collect()) or [size]  # ``size`` numbers at most
    hint = F.broadcast if table.count() <= BROADCAST_ROWS else (lambda x: x)
    text = F.col(text_col).cast("string")
    texts = docs.where(text.isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    keys = ["doc_id", "version", "item_id", "item_version"]
    candidates = cut_lineage(
        _shingles(texts, widths).join(hint(table.where("minimum").select("h", "item_id", "item_version")), "h").select(*keys).distinct(),
        "candidates")
    same = lambda a, b, cols: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])
    who = candidates.select("doc_id", "version").distinct()
    texts = texts.join(who, same(texts, who, ["doc_id", "version"]), "left_semi")
    found = _shingles(texts, widths).join(hint(table.select("h", "n", "item_id", "item_version")), "h")
    found = found.join(candidates, same(found, candidates, keys), "left_semi")
    return (found.groupBy(*keys, "n").agg(F.countDistinct("h").alias("n_found"))
            .where(F.col("n_found") >= threshold * F.col("n") - 1e-9)
            .select("doc_id", "version", "item_id", F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment")))


def drop_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows whose text contains an item."""
    own_id, version = unused(docs, "leak_id"), unused(docs, "leak_version")
    leaks = cut_lineage(find_leaks(docs, items, **how).select(F.col("doc_id").alias(own_id), F.col("version").alias(version)).distinct(), "leaks")
    return docs.join(leaks, F.col(how.get("id_col", "doc_id")).cast("long").eqNullSafe(F.col(own_id))
                     & (F.xxhash64(F.col(how.get("text_col", "text")).cast("string")) == F.col(version)), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains, over all of ``documents`` and ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("version")


OP10_SQL = """
WITH dw AS (SELECT DISTINCT doc_id, md5(text) AS version, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
            FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, k, list_sort(list_distinct(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' ')))) AS hs
      FROM (SELECT item_id, w, least(len(w), 5) AS k FROM iw WHERE len(w) > 0)),
s AS (SELECT item_id, k, hs, unnest(hs) AS s FROM i),
d AS (SELECT DISTINCT doc_id, version, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s
      FROM dw CROSS JOIN (SELECT DISTINCT k FROM i)),
f AS (SELECT doc_id, version, item_id, hs, count(*) AS n_found FROM d JOIN s USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, len(hs) AS n_shingles, n_found, n_found / len(hs) AS containment
FROM f WHERE n_found >= 0.8 * len(hs)
"""
