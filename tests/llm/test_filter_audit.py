"""The filter audit against a plain loop over all orders, and against its SQL."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from framequarry.llm import filter_audit

from .test_llm import oracle_tables, words


DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, n long, rank int, digest string"
LABELS = "doc_id long, quality int, toxic int, good int"


def rows(texts):
    return [(i, t, "en", (None, "a", "b", "")[(i or 0) % 4], 1, "x", 7, 3, 2, "d") for i, t in texts]


def odd():
    long = words(300, 1)
    texts = [None, "", "  \n", "a b c", "x" * 3000, long, long.upper(), long + " $", "same " * 250, "SAME " * 250, words(5000, 2), "ÉÉ ABC " + words(220, 3), "a|b", long, long, "", None, words(400, 4, 30), "  a  b\tc\x0bd  "]
    out = list(enumerate(texts))
    return [*out, (3, "a b c"), (3, "a b c"), (5, "other " + long), (None, long), (None, "a b c"), (40, "a b c"), (40, "a b c")]


def loops(docs, labels):
    """Rows by applying every order to every document."""
    good, toxic = {d for d, q, *_ in labels if q == 1 and d is not None}, {d for d, _, t, *_ in labels if t == 1 and d is not None}
    least = {}
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    failed = []
    for d, text, _, source, *_ in docs:
        t = text or ""
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d}
        failed.append((source or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = []
    for part in {p for p, *_ in failed}:
        own = [x for x in failed if x[0] == part]
        first = {}
        for order in permutations("ABCDE"):
            kept = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in kept if letter in x[1]]
                kept = [x for x in kept if letter not in x[1]]
                fails = [x for x in own if letter in x[1]]
                out.append([part, "".join(order), step, letter, len(kept), len(gone), len(fails) - len(gone), sum(x[1] == {letter} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)])
                first[letter] = first.get(letter, 0) + len(gone)
        for r in out:
            if r[0] == part:
                r.append(first[r[3]])
    return sorted(map(tuple, out))


COLUMNS = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("texts", [odd(), []], ids=["odd", "empty"])
def test_audit(spark, texts):
    docs = rows(texts)
    labels = [(0, 1, 0, 1), (1, None, 1, 1), (5, 1, 1, 1), (5, 0, 0, 1), (6, 1, None, 1), (None, 1, 1, 1), (13, 1, 0, 1), (40, 1, 1, 0), (99, 1, 1, 0)]
    d, marks = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    found = filter_audit.audit(d, marks)
    assert found.columns == COLUMNS
    got = sorted(map(tuple, found.collect()))
    assert got == loops(docs, labels)
    named = d.where("doc_id IS NOT NULL")
    names, want = oracle_tables(filter_audit.SQL, documents=named, labels=marks)
    assert sorted(tuple(r[c] for c in names) for r in filter_audit.audit(named, marks).collect()) == want


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame(rows([(1, "a"), (2, "a b"), (3, "b"), (4, "a")]), DOCS)
    has = lambda letter: lambda: F.col("text").contains(letter)
    got = filter_audit.audit(docs.withColumn("source", F.lit("s")), spark.createDataFrame([], LABELS), {"a ": has("a"), "b ": has("b")}, copies=None).collect()
    assert {(r.filter_order, r.step, r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got} == {("a b ", 1, "a ", 1, 3, 0, 2, 5), ("a b ", 2, "b ", 0, 1, 1, 1, 3), ("b a ", 1, "b ", 2, 2, 0, 1, 3), ("b a ", 2, "a ", 0, 2, 1, 2, 5)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, docs, {}, copies=None)


def test_intervals_cover_every_order_once():
    for k in (1, 3, 5):
        for mask in range(1 << k):
            ranks = sorted(r for m, _, lo, hi in filter_audit.intervals(k) for r in range(lo, hi) if m == mask)
            assert ranks == (list(range(len(list(permutations(range(k)))))) if mask else [])
