"""Interaction audit of a set of filters: what each removes, at every place of every order in which they can be applied.

1. Every document becomes a mask of the filters that it fails, and documents are counted by (part, mask): at most two to
   the number of filters rows for a part, whatever its size. Copies are told by the SHA-256 digest of their text. Rows of
   one text are first combined to a row per (part, labels), so a group of copies, however large, is a few rows.
2. Orders are numbered by their Lehmer rank, the place in lexicographic order. The orders that begin with the same filters
   have consecutive ranks. A mask is removed at step k by filter f in the orders that begin with k - 1 filters that it
   passes and then f, which is one interval of ranks for every such beginning.
3. Each interval adds the mask's count at its first rank and takes it away after its last: a difference array over the
   ranks for each part and step. Its prefix sums are the documents removed in each order. Orders are never applied one
   by one, and the work after step 1 does not depend on the number of documents.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, scratch

#: Bytes between words.
BLANKS = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: A filter's name, and whether a text fails it, as an expression of the columns text, n_words, n_distinct and n_chars.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 200,
    "B": lambda: F.col("n_distinct") * 100 < F.col("n_words") * 50,
    "C": lambda: F.length(F.regexp_replace("text", "[^A-Z]+", "")) * 100 > F.col("n_chars") * 2,
    "D": lambda: F.col("text").rlike("[#$%&*|]"),
}
#: The filter that a text fails if a smaller doc_id has the same text.
COPIES = "E"


def measured(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, text, n_chars, n_words, n_distinct) of every row; null texts and parts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"), F.btrim(text, F.lit(BLANKS)).alias("inner"))
    d = d.select("doc_id", "part", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("inner") != "", F.split("inner", WORD_BREAK)).otherwise(F.array()).alias("words"))
    return d.select("doc_id", "part", "text", "n_chars", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


def masks(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[], Column]] = FILTERS, copies: str | None = COPIES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, bit i for the filter i of ``filters``, then ``copies``."""
    bits = [F.when(fails(), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = sum(bits, F.lit(0)).cast("int").alias("mask")
    d = measured(docs, id_col, text_col, part_col).select("doc_id", "part", mask, F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    d = d.join(marks, "doc_id", "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})
    kind = ["part", "mask", "good", "toxic"]
    if copies is None:
        found = d.groupBy(*kind).agg(F.count("*").alias("n"))
    else:
        # Rows that repeat text and doc_id count together; then the least doc_id of each text within a part, and how many rows have it.
        rows = d.groupBy("digest", "doc_id", *kind).agg(F.count("*").alias("n"))
        least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
        texts = rows.groupBy("digest", *kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least)
        first = F.min("least.doc_id").over(Window.partitionBy("digest"))
        texts = texts.withColumn("first", F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
        both = F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
        found = texts.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    amount = {"n": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    return found.groupBy("part", "mask").agg(*[F.sum(v).cast("long").alias(k) for k, v in amount.items()])


def intervals(k: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders of ``k`` filters in which a mask is removed at a step."""
    out = []
    for step in range(1, k + 1):
        span = factorial(k - step)
        for i, begin in enumerate(permutations(range(k), step)):  # in lexicographic order, so the i-th covers the i-th span
            passed, by = sum(1 << f for f in begin[:-1]), 1 << begin[-1]
            out += [(m, step, i * span, (i + 1) * span) for m in range(1 << k) if m & by and not m & passed]
    return out


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[], Column]] = FILTERS, copies: str | None = COPIES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters (names joined) and step, zeros included: part, filter_order, step, filter,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Up to eight filters in all, taken in the order of ``filters``, then ``copies`` (None: without). Null texts and parts
    count as empty; rows that repeat a doc_id count one by one, and a text is no copy of its own doc_id; a row without
    doc_id is no copy and makes none. A document counts as good or toxic if any of its labels is 1. Long texts are read
    whole. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    names = [*filters, *([copies] if copies is not None else [])]
    k = len(names)
    if not 1 <= k <= 8 or len(set(names)) < k:
        raise ValueError("one to eight filters with different names")
    counted = ["n", "good", "toxic"]
    with scratch(spark):
        held = materialize(masks(docs, labels, filters, copies, id_col, text_col, part_col), "audit-masks")
        # Two ends of every interval; a fixed table whose size depends on the number of filters alone.
        spans = spark.createDataFrame(intervals(k), "mask int, step int, lo int, hi int")
        ends = F.array(*[F.struct(F.col(at).alias("rank"), *[(F.col(c) * sign).alias(f"d_{c}") for c in counted]) for at, sign in (("lo", 1), ("hi", -1))])
        steps = held.join(F.broadcast(spans), "mask").select("part", "step", F.inline(ends)).groupBy("part", "step", "rank").agg(*[F.sum(f"d_{c}").alias(f"d_{c}") for c in counted])
        fails = F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(k)])
        only = F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(k)])
        totals = held.groupBy("part").agg(F.sum("n").alias("total"), fails.alias("fails"), only.alias("only"))
        grid = totals.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")).select("*", F.explode(F.sequence(F.lit(0), F.lit(factorial(k) - 1))).alias("rank"))
        cells = steps.where(F.col("rank") < factorial(k)).unionByName(grid, allowMissingColumns=True).repartition("part")
        cells = cells.groupBy("part", "step", "rank").agg(*[F.coalesce(F.sum(f"d_{c}"), F.lit(0)).alias(f"d_{c}") for c in counted], *[F.max(c).alias(c) for c in ("total", "fails", "only")])
        along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.select("part", "step", "rank", "total", "fails", "only", *[F.sum(f"d_{c}").over(along).alias(c) for c in counted])
        orders = spark.createDataFrame([(i, list(p)) for i, p in enumerate(permutations(range(k)))], "rank int, places array<int>")
        cells = cells.join(F.broadcast(orders), "rank").withColumn("f", F.element_at("places", F.col("step")) + 1)
        name = lambda place: F.element_at(F.array(*map(F.lit, names)), place)
        so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        found = cells.select(
            "part",
            F.array_join(F.transform("places", lambda p: name(p + 1)), "").alias("filter_order"),
            "step",
            name(F.col("f")).alias("filter"),
            (F.col("total") - F.sum("n").over(so_far)).alias("kept"),
            F.col("n").alias("removed"),
            (F.element_at("fails", F.col("f")) - F.col("n")).alias("redundant"),
            F.element_at("only", F.col("f")).alias("unique_fails"),
            F.col("good").alias("good_lost"),
            F.col("toxic").alias("toxic_lost"),
            F.sum("n").over(Window.partitionBy("part", "f")).alias("shapley"),
        )
        return materialize(found, "audit", keep=True)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN first_id < doc_id THEN 'E' ELSE '' END AS failed
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
p(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || f FROM p, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS before
      FROM p, range(1, 6) r(step) WHERE length(filter_order) = 5),
j AS (SELECT part, filter_order, step, filter, n, good, toxic, contains(failed, filter) AS fails, failed = filter AS only_this,
             before <> '' AND regexp_matches(failed, '[' || coalesce(nullif(before, ''), '-') || ']') AS gone FROM c, s),
a AS (SELECT part, filter_order, step, filter,
             sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
      FROM j GROUP BY ALL)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM a
"""
