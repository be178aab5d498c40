"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes (insult stem, harm, agent, intention, target, negation, speech verb, other). Small weighted transducers,
each a table of transitions, read the classes of a clause: TARGET + INSULT in either order (a person is insulted), a threat:
AGENT + INTENTION + HARM with a PERSON on either side of the harm (I will hurt you), or HARM at the head of the clause with
a PERSON right after it (an order), INSULT before a threat, NEGATION before an insult or harm (weight is taken back), SPEECH
before a clause (somebody else is reported to have said it; the state reaches over a colon or an opening quote into the
clause that is reported). Harm without somebody who means to do it, or done to things, has no weight. Words masked with
digits or signs are read in their place. The grammar is the composition of the transducers: its states are tuples of theirs,
its factors the products. Clause weights add up to the document's log-odds; a clause that is nothing but one word is no
pattern and does not pass the threshold by itself, and neither does an insult or a threat that is reported.

The insult stems and their weights are learned from labelled documents that are not held out (a bounded
sample of each label): word beginnings and whole words that toxic documents have and others have not. The
closed classes (pronouns, intentions, negations, speech verbs) are fixed word lists of common European languages.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .shared import bounded_batches, materialize

# Closed word classes.
TARGETS = frozenset("u he she they we du ihr sie er tu ton ta tes votre vos il elle ils elles leur tú usted ustedes tus ellos ellas él ella dein deine".split())
#: Possessives that make a target of who they stand for, without being somebody to whom a deed is done.
OWNERS = frozenset("your yours his their".split())
#: Those to whom a deed named before them is done, and object pronouns that stand on either side of it.
SUFFERS = frozenset("you him them her us".split())
#: Who is said to mean a deed; those of the second list are targets of insults as well.
AGENTS = frozenset("i ich je j'ai yo i'm i'd".split())
AGENTS_TOO = frozenset("we they he she".split())
OTHER_AGENTS = frozenset("wir nous nosotros we're we'd".split())
#: That a deed is meant; in the second list together with who means it.
INTENDS = frozenset("will shall gonna going wanna want werde werden möchte wollen vais allons veux voulons".split())
WILLED = frozenset("i'll we'll they'll voy vamos quiero queremos".split())
OBJECTS = frozenset("dich dir euch ihn ihm te toi vous lui ti".split())
THREATS = frozenset("kill hurt destroy murder beat punch shoot stab burn töten schlagen vernichten umbringen tuer frapper détruire brûler matar golpear destruir quemar".split())
NEGATIONS = frozenset("not no never n't isn't aren't wasn't don't won't nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split())
SPEECH = frozenset("said says say told called reported wrote quoted sagte sagt nannte schrieb berichtete dit disait appelait écrit rapporte dijo dice llamó escribió".split())
OTHER, INSULT, THREAT, TARGET, NEGATION, SPEAKS, SUFFERER, OBJECT, AGENT, WE, INTENTION, WILL, BEGIN = range(13)
CLAUSE = regex.compile(r"[.!?;\n]+|:")
WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}]+)?")
LEET = str.maketrans("013457@$", "oieastas")
MASKED = regex.compile(r"\b(?=[\p{L}@$0-9]*\p{L})(?=\p{L}*[@$0-9])[\p{L}@$0-9]{3,}\b")
MARKS = regex.compile(r"[@$0-9]")
STEM_LENGTHS = range(3, 9)
#: Weights of the grammar in units of the stem's weight.
DIRECTED, NEGATED, REPORTED, LONE = 1.5, 0.5, 0.55, 0.8
#: Weight of a word of harm, before the factors of its clause; one that is aimed at somebody passes the threshold.
THREATENED = 4.0
#: Log-odds of a text without evidence; least and greatest weight of a stem.
BIAS, LEAST_ODDS, MOST_ODDS = -4.5, 2.0, 6.0
#: Toxic documents that outweigh a clean one, at equal shares, when a stem is chosen.
CLEAN_COST = 8
#: Stems after which a toxic document of the sample counts as explained.
EXPLAINED = 3

#: Transducers as {(state, class): (next state, factor of an insult's or a threat's weight)}; a missing entry keeps the state.
NEGATION_T = {("", NEGATION): ("neg", 1), ("neg", INSULT): ("", NEGATED), ("neg", THREAT): ("", NEGATED)}
TARGET_T = {("", k): ("aimed", 1) for k in (TARGET, SUFFERER, OBJECT, WE)} | {("aimed", INSULT): ("aimed", DIRECTED)}
REPORT_T = {("", SPEAKS): ("told", 1), ("told", INSULT): ("told", REPORTED), ("told", THREAT): ("told", REPORTED)}
INSULT_T = {("", INSULT): ("insulted", 1), ("insulted", THREAT): ("insulted", DIRECTED)}
#: Somebody means to do it: agent, intention, then the harm with a person before or after it.
THREAT_T = {("", AGENT): ("agent", 1), ("", WE): ("agent", 1), ("", WILL): ("meant", 1), ("agent", INTENTION): ("meant", 1), ("agent", WILL): ("meant", 1), ("", OBJECT): ("object", 1), ("object", AGENT): ("both", 1), ("object", WE): ("both", 1), ("object", WILL): ("somebody", 1), ("agent", OBJECT): ("both", 1), ("both", INTENTION): ("somebody", 1), ("both", WILL): ("somebody", 1), ("meant", OBJECT): ("somebody", 1), ("meant", THREAT): ("harm", DIRECTED), ("somebody", THREAT): ("announced", DIRECTED), ("harm", SUFFERER): ("announced", 1), ("harm", OBJECT): ("announced", 1)}
#: It is ordered: the harm at the head of the clause, a person right after it.
ORDER_T = {("", BEGIN): ("head", 1)} | {("head", k): ("past", 1) for k in range(BEGIN)} | {("head", THREAT): ("harm", DIRECTED)} | {("harm", k): ("past", 1) for k in range(BEGIN)} | {("harm", SUFFERER): ("announced", 1), ("harm", OBJECT): ("announced", 1)}
GRAMMAR = (NEGATION_T, TARGET_T, REPORT_T, INSULT_T, THREAT_T, ORDER_T)
AIMS = frozenset((TARGET, SUFFERER, OBJECT, WE))
CLASSES = ((THREAT, THREATS), (WE, AGENTS_TOO), (TARGET, TARGETS | OWNERS), (SUFFERER, SUFFERS), (OBJECT, OBJECTS), (AGENT, AGENTS | OTHER_AGENTS), (INTENTION, INTENDS), (WILL, WILLED), (NEGATION, NEGATIONS), (SPEAKS, SPEECH))
#: States of the composition: one of each transducer.
START = ("",) * len(GRAMMAR)


class Composition(dict):
    """{(state, class): (next state, factor)} of the composed transducers, made as they are asked for."""

    def __missing__(self, key: tuple) -> tuple:
        states, kind = key
        steps = [table.get((q, kind), (q, 1)) for table, q in zip(GRAMMAR, states, strict=True)]
        self[key] = tuple(q for q, _ in steps), math.prod(f for _, f in steps)
        return self[key]


COMPOSED = Composition()


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Grammar:
    def __init__(self, stems: dict[str, float], bias: float):
        self.stems, self.bias = stems, bias
        self.classes: dict[str, tuple[int, float]] = {}

    def classify(self, word: str) -> tuple[int, float]:
        """Class and weight of a word: its longest learned stem, else its closed class."""
        got = self.classes.get(word)
        if got is None:
            got = (OTHER, 0.0)
            if f"={word}" in self.stems:
                got = (INSULT, self.stems[f"={word}"])
            else:
                for n in range(min(len(word), STEM_LENGTHS[-1]), STEM_LENGTHS[0] - 1, -1):
                    if word[:n] in self.stems:
                        got = (INSULT, self.stems[word[:n]])
                        break
                else:
                    for kind, listed in CLASSES:
                        if word in listed:
                            got = (kind, 0.0)
                            break
            if len(self.classes) < 300_000:
                self.classes[word] = got
        return got

    def clause(self, kinds: list[tuple[int, float]], told: bool = False) -> float:
        """Weight of a clause, read by the composed grammar; ``told`` if it is what somebody is reported to have said."""
        state = tuple("told" if told and table is REPORT_T else "" for table in GRAMMAR)
        total, harm, loose = 0.0, 0.0, 0.0
        state, _ = COMPOSED[state, BEGIN]
        for kind, weight in kinds:
            state, factor = COMPOSED[state, kind]
            if kind == INSULT:
                total += weight * factor
                if state[1] != "aimed":
                    loose += weight * factor
            elif kind == THREAT:
                harm = max(harm, THREATENED * factor)
            elif kind in AIMS and loose:  # the one insulted is named after the insult
                total += loose * (DIRECTED - 1)
                loose = 0.0
        return (total if len(kinds) > 1 else total * LONE) + (harm if "announced" in state[-2:] else 0.0)

    def weight(self, text: str | None) -> float:
        low = (text or "").lower()
        if MARKS.search(low):  # letters written as digits or signs, where that makes an insult or a word of harm
            low = MASKED.sub(self.unmask, low)
        if not any(self.classify(w)[0] in (INSULT, THREAT) for w in set(WORD.findall(low))):
            return 0.0
        total, at, told = 0.0, 0, False
        for end in [*CLAUSE.finditer(low), None]:
            part = low[at : end.start() if end else len(low)]
            kinds = [self.classify(w) for w in WORD.findall(part)]
            if any(k in (INSULT, THREAT) for k, _ in kinds):
                total += self.clause(kinds, told)
            if end:
                spoken = told or any(k == SPEAKS for k, _ in kinds)
                told = spoken and (end[0] == ":" or low[at : end.start()].count('"') % 2 == 1 and not told)
                at = end.end()
        return total

    def unmask(self, found: regex.Match) -> str:
        plain = found[0].translate(LEET)
        return plain if self.classify(plain)[0] in (INSULT, THREAT) else found[0]

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.weight(text)))))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 3000, clean_rows: int = 12000, least_support: int = 5) -> Grammar:
    """Learn stems from labelled documents that are not held out: at most ``toxic_rows`` and ``clean_rows`` of them.

    Rows without id, text or label do not count; a document with conflicting labels counts as toxic. Rows of ``docs``
    that repeat a chosen doc_id are examples of their own, all with its label. Without toxic
    examples the grammar has no stems and scores every text alike.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")
    chosen = [r for kind, most in ((1, toxic_rows), (0, clean_rows)) for r in rows.where(f"toxic = {kind}").orderBy(*order).limit(most).collect()]
    shared = spark.sparkContext.broadcast({r.doc_id: int(r.toxic) for r in chosen})  # toxic_rows + clean_rows ids

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([d in shared.value for d in batch.column(0).to_pylist()]))

    texts = materialize(docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(sampled, "doc_id long, text string"), "toxicity-sample")

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shared.value[doc]:
                    seen.update(document_stems(text))
        if seen:
            yield pa.RecordBatch.from_pydict({"stem": pa.array(list(seen)), "n": pa.array(list(seen.values()), pa.int64())})

    n1 = sum(shared.value.values())
    support = max(least_support, n1 // 100)
    common = texts.mapInArrow(stems, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n")).where(f"n >= {support}").select("stem")
    names = sorted(r.stem for r in common.collect())  # each in a hundredth of the toxic sample at least
    number = spark.sparkContext.broadcast({s: i for i, s in enumerate(names)})

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = [number.value[s] for s in document_stems(text) if s in number.value]
                yield pa.RecordBatch.from_pydict({"toxic": pa.array([shared.value[doc]], pa.int32()), "stems": pa.array([np.array(got, "<i4").tobytes()], pa.binary())})

    found = texts.mapInArrow(present, "toxic int, stems binary").collect()
    return Grammar(learn(names, [(r.toxic, np.frombuffer(r.stems, "<i4")) for r in found], support), BIAS)


def document_stems(text: str | None) -> set[str]:
    """Whole words (marked by =) and word beginnings of a text."""
    words = set(words_of(text))
    return {f"={w}" for w in words} | {w[:k] for w in words for k in STEM_LENGTHS if len(w) > k}


def learn(names: list[str], docs: list[tuple[int, np.ndarray]], support: int) -> dict[str, float]:
    """Few stems that explain the toxic documents: {stem: weight (bounded log-odds of the document shares)}.

    Greedy: each step takes the stem in most toxic documents that ``EXPLAINED`` taken stems do not explain yet, less
    its share of clean ones. So words that only go along with long or foreign documents are not taken. Of equal stems
    the longest is taken, and none that begins, or is begun by, a taken one.
    """
    toxic, clean = [s for t, s in docs if t], [s for t, s in docs if not t]
    n1, n0 = len(toxic), len(clean)
    if not n1:
        return {}
    t = np.bincount(np.concatenate(toxic), minlength=len(names)).astype(float)
    c = np.bincount(np.concatenate(clean), minlength=len(names)).astype(float) if clean else np.zeros(len(names))
    odds = np.log((t + 0.5) / (n1 + 1)) - np.log((c + 1.5) / (n0 + 1))
    gain, need = t.copy(), np.full(n1, EXPLAINED)
    cost = CLEAN_COST * n1 / max(n0, 1) * c
    free = odds > LEAST_ODDS
    longest = np.array([len(s) + (s[0] == "=") * 0.5 for s in names]) if names else np.zeros(0)
    where: dict[int, list[int]] = {}
    for d, s in enumerate(toxic):
        for i in s[free[s]].tolist():
            where.setdefault(i, []).append(d)
    out: dict[str, float] = {}
    while free.any():
        value = np.where(free, gain - cost, -1.0)
        best = int(np.lexsort((longest, value))[-1])
        if value[best] < support:
            break
        name = names[best].lstrip("=")
        out[names[best]] = float(min(MOST_ODDS, np.log((t[best] + 0.5) / (n1 + 1)) - np.log((c[best] + 0.5) / (n0 + 1))))
        for i in np.flatnonzero(free).tolist():
            other = names[i].lstrip("=")
            free[i] = not (other.startswith(name) or name.startswith(other))
        for d in where[best]:
            need[d] -= 1
            if need[d] == 0:
                gain[toxic[d]] -= 1
    return out


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Null and empty texts get the score of no evidence; rows that repeat a
    doc_id are scored one by one, each by its own text; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shared.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(s, pa.float64())})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
