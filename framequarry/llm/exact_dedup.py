"""Exact deduplication by an extendible-hash index on shared files, in DataFrame operations only.

1. Entries (hash, digest of the normalised text, doc_id, code points), one per document, are written once. A hash that
   one entry alone has needs no text; documents whose hash is shared are written with their texts.
2. Equal texts are combined before they are dealt out, to at most ``SALTS`` entries with a count and the best row, so a
   group of copies, whatever its size, is a few entries.
3. The directory starts with one bucket. While a bucket holds more than ``capacity`` hashes, the directory doubles and the
   bucket splits by the next bit of the hash; ``LEVEL`` doublings are taken on the counts of that many bits, and only
   buckets that are still overfull go on to the next ones.
4. Entries are dealt to owner tasks by ranges of (bucket, hash), which keeps a chain, all entries of one hash, inside its
   owner. The owner compares the texts of a chain byte for byte, adds up entries that are equal, numbers the links of the
   chain, and writes its part of the index to the shared folder. This takes no further shuffle.
5. The index files are the verdicts: size and row that stays of every group are read from them by hash and digest, and
   by the text as well where a chain holds several texts of one digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import few, free, materialize, scratch, small

BLANKS = r"[\x20\x09-\x0D]"
#: Bits of a hash, and of them those that one level of the directory counts (at most 16 384 counts).
HASH_BITS, LEVEL = 60, 14
#: Entries that equal texts are combined to before owners add them up.
SALTS = 16


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column] | None) -> DataFrame:
    """(doc_id, chars, sha, digest, norm) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(text)
    d = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("chars"), F.sha2(norm, 256).alias("sha"), norm.alias("norm"))
    return d.withColumn("digest", digest(F.col("norm")) if digest else F.col("sha"))


def doubled(keys: DataFrame, level: int, capacity: int) -> DataFrame:
    """(prefix, held, depth): buckets of the prefixes of one level after its doublings, with the hashes that they hold."""
    top = (level + 1) * LEVEL
    prefix = F.shiftright("hash", HASH_BITS - top) if top <= HASH_BITS else F.shiftleft("hash", top - HASH_BITS)
    d = keys.groupBy(prefix.alias("prefix")).agg(F.count_distinct("hash").alias("n")).withColumn("depth", F.lit(level * LEVEL))
    for split in range(LEVEL + 1):
        bucket = Window.partitionBy("depth", F.expr(f"shiftright(prefix, {top} - depth)"))
        d = d.withColumn("held", F.sum("n").over(bucket))
        if split < LEVEL:  # a bucket that has stayed behind once is not overfull and stays
            d = d.withColumn("depth", F.when(F.expr(f"held > {capacity} AND depth = {level * LEVEL + split}"), F.col("depth") + 1).otherwise(F.col("depth")))
    return d


def bucketed(keys: DataFrame, capacity: int) -> DataFrame:
    """``keys`` with the bucket of each, named by a one and the bits that its depth takes."""
    out, level = None, 0
    while True:
        top = (level + 1) * LEVEL
        buckets = materialize(few(doubled(keys, level, capacity), 1 << LEVEL), "dedup-directory")  # at most 2 ** LEVEL rows for each overfull bucket
        here = keys.withColumn("prefix", F.shiftright("hash", HASH_BITS - top) if top <= HASH_BITS else F.shiftleft("hash", top - HASH_BITS)).join(small(buckets), "prefix")
        full = F.expr(f"held > {capacity} AND depth = {top}") if top < HASH_BITS else F.lit(False)
        name = F.expr(f"shiftright(prefix, {top} - depth)") + F.expr("shiftleft(1L, depth)")
        done = here.where(~full).withColumn("bucket", name).drop("prefix", "n", "depth", "held")
        out = done if out is None else out.unionByName(done)
        if top >= HASH_BITS or buckets.where(full).isEmpty():
            return out.select("bucket", *keys.columns)
        keys = materialize(here.where(full).select(*keys.columns), "dedup-overfull")
        level += 1


def indexed(entries: DataFrame, capacity: int) -> DataFrame:
    """The index of ``entries`` (hash, digest, norm, size, best), a written table: (bucket, hash, link, digest, texts, norm,
    size, best), a row per group, made by the owner of its bucket. ``link`` is its place in the chain of its hash; ``texts``
    are the groups that share its digest, and ``norm`` is kept where there are several.
    """
    owned = bucketed(entries, capacity).repartitionByRange("bucket", "hash")
    groups = owned.groupBy("bucket", "hash", "digest", "norm").agg(F.sum("size").alias("size"), F.min("best").alias("best"))
    link = F.row_number().over(Window.partitionBy("bucket", "hash").orderBy("digest", "norm"))
    texts = F.count("*").over(Window.partitionBy("bucket", "hash", "digest"))
    return groups.select("bucket", "hash", link.alias("link"), "digest", texts.alias("texts"), "norm", "size", "best").withColumn("norm", F.when(F.col("texts") > 1, F.col("norm")))


def _exact_groups(docs: DataFrame, capacity: int, id_col: str, text_col: str, digest: Callable[[Column], Column] | None) -> DataFrame:
    """``exact_groups`` with the columns chars and sha, without the clean-up; its result still reads the index."""
    d = keyed(docs, id_col, text_col, digest).withColumn("hash", F.conv(F.substring("digest", 1, HASH_BITS // 4), 16, 10).cast("long"))
    narrow = ["hash", "digest", "doc_id", "chars", "sha"]
    entries = materialize(d.select(*narrow), "dedup-entries", compression="zstd")
    shared = small(materialize(entries.groupBy("hash").count().where("count > 1").select("hash"), "dedup-shared"))
    alone = entries.join(shared, "hash", "left_anti").withColumn("row", F.lit(0).cast("long"))
    copies = materialize(d.join(shared, "hash", "left_semi").select(*narrow, "norm", F.monotonically_increasing_id().alias("row")), "dedup-copies", compression="zstd")
    rank = F.struct((-F.col("chars")).alias("c"), "doc_id", "row")
    combined = copies.groupBy("hash", "digest", "norm", F.pmod("row", F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("size"), F.min(rank).alias("best")).drop("salt")
    single = alone.select("hash", "digest", F.lit(None).cast("string").alias("norm"), F.lit(1).cast("long").alias("size"), rank.alias("best"))
    dealt = materialize(single.unionByName(combined), "dedup-dealt", compression="zstd")
    index = materialize(indexed(dealt, capacity), "dedup-index", compression="zstd")
    shape = ["doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), F.expr("row = best.row").alias("kept"), F.col("sha").alias("text_sha256"), "chars"]
    found = alone.unionByName(copies.drop("norm")).join(index.where("texts = 1").select("hash", "digest", "size", "best"), ["hash", "digest"]).select(*shape)
    several = index.where("texts > 1").select("hash", "digest", "norm", "size", "best")
    if several.isEmpty():
        return found
    return found.union(copies.join(several, ["hash", "digest", "norm"]).select(*shape))


def exact_groups(docs: DataFrame, capacity: int = 100_000, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Kept is, of equal normalised texts, the row with the most code points in its original text, then the smallest id;
    of rows that repeat both, one. Null texts count as empty; all empty texts form one group. Rows that repeat an id
    are grouped one by one; a null id counts as the smallest. An empty table gives no rows. Other columns of ``docs``
    are not looked at. ``digest`` makes hexadecimal digests of 15 digits or more from normalised texts (SHA-256).
    """
    with scratch(docs.sparkSession):
        found = _exact_groups(docs, capacity, id_col, text_col, digest).drop("chars")
        return materialize(found, "exact-groups", keep=True, compression="zstd")


def drop_exact_copies(docs: DataFrame, capacity: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all columns."""
    with scratch(docs.sparkSession):
        found = materialize(_exact_groups(docs, capacity, id_col, text_col, None).select("doc_id", "kept", "text_sha256", "chars"), "exact-found", keep=True, compression="zstd")
    lost_id, key, sha, chars = free(docs, "lost_id", "key", "sha", "chars")
    own = docs[id_col]
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        lost = small(materialize(found.where("NOT kept").select(F.col("doc_id").alias(lost_id)), "exact-lost"))
        return docs.join(lost, own.eqNullSafe(F.col(lost_id)), "left_anti")
    # Repeated ids: rows are told apart by text and length as well, and of rows that are alike in all three one stays.
    kept = found.where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha), F.col("chars").alias(chars))
    text = F.coalesce(docs[text_col], F.lit(""))
    on = own.eqNullSafe(F.col(key)) & (F.sha2(normalised(text), 256) == F.col(sha)) & (F.length(text) == F.col(chars))
    return docs.join(kept, on).dropDuplicates([key, sha]).select(*[docs[c] for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS chars, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') AS s FROM d),
g AS (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS group_size,
             first_value(doc_id) OVER (PARTITION BY s ORDER BY chars DESC, doc_id NULLS FIRST) AS keep_id,
             row_number() OVER (PARTITION BY s ORDER BY chars DESC, doc_id NULLS FIRST) = 1 AS kept FROM n)
SELECT doc_id, keep_id, group_size, kept, sha256(s) AS text_sha256 FROM g
"""
