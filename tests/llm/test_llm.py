import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framequarry.llm import chat_format, components, decontaminate, exact_dedup, fm_index, html_extract, language_id, ngram_join, packing, shared, substring_dedup, textarrays, token_files, toxicity
from framequarry.llm.queries import byte_bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, kept string"
SF = "/root/testdata/sf0.001"


def documents(spark, texts, sources=None):
    """Documents with extra columns whose names clash with those that operators use."""
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or ""), "h", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed=0, vocabulary=3000):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


def hard_texts():
    long = words(8_000, 5)
    base = words(120, 1)
    passage = words(40, 2)
    return [None, "", "   \n", "one", "two words", base, base, base.upper(), base + " tail", base.replace("w", "W", 3), "日本語 のテキスト " * 9, long, long + " x", words(60, 3) + " " + passage + " " + words(50, 4), passage, words(30, 6) + "\n" + passage + "\t" + words(9, 7), "a" * 5000, "<|endoftext|> x", "é\x85\xa0 \x1c y", base]


def oracle(sql, docs, benchmark=None):
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    if benchmark is not None:
        c.register("benchmark", benchmark.toPandas())
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return names, sorted(map(tuple, r.fetchall()))


def oracle_tables(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df.toArrow())
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return names, sorted(map(tuple, r.fetchall()))


def same(df, names, rows):
    got = sorted(tuple(r[c] for c in names) for r in df.collect())
    assert got == rows


@pytest.mark.parametrize("texts", [hard_texts(), []], ids=["hard", "empty"])
@pytest.mark.parametrize("op", ["exact", "substring", "jaccard"])
def test_against_sql(spark, op, texts):
    docs = documents(spark, texts).repartition(3)
    run, sql = {"exact": (exact_dedup.exact_groups, exact_dedup.SQL), "substring": (substring_dedup.removals, substring_dedup.SQL), "jaccard": (ngram_join.near_duplicates, ngram_join.SQL)}[op]
    same(run(docs), *oracle(sql, docs))


def test_ngram_pairs_that_dense_blocks_hold_back(spark, monkeypatch):
    """A dense pass without a new pair is not the end where blocks held pairs back."""
    cross = ngram_join._cross

    def nothing_new(percent, dense):
        def run(batches):
            for _ in batches:
                pass
            yield pa.RecordBatch.from_pydict({"a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64())})

        return run if dense else cross(percent, dense)

    rng = np.random.default_rng(4)
    base = words(60, 3).split()
    texts = []
    for i in range(24):  # a chain of edits: neighbours are linked, far ones are not
        base = [f"e{i}-{k}" if k in set(rng.integers(0, 60, 2).tolist()) else w for k, w in enumerate(base)]
        texts.append(" ".join(base))
    docs = documents(spark, texts + texts[::5])
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 1)
    monkeypatch.setattr(ngram_join, "_cross", nothing_new)
    monkeypatch.setattr(ngram_join, "plausible", lambda pairs, *_: pairs.where("false"))  # the pivots find nothing either
    same(ngram_join.near_duplicates(docs), *oracle(ngram_join.SQL, docs))


def test_exact_directory_splits_buckets(spark, monkeypatch):
    docs = documents(spark, [f"t{i // 2}" for i in range(200)])
    monkeypatch.setattr(exact_dedup, "LEVEL", 3)  # several levels
    same(exact_dedup.exact_groups(docs, capacity=3), *oracle(exact_dedup.SQL, docs))
    keys = exact_dedup.keyed(docs, "doc_id", "text", None).select(F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("hash")).distinct()
    buckets = {}
    for r in exact_dedup.bucketed(keys, 3).collect():
        buckets.setdefault(bin(r.bucket)[3:], []).append(f"{r.hash:060b}")
    assert all(len(v) <= 3 and all(h.startswith(b) for h in v) for b, v in buckets.items()) and sum(map(len, buckets.values())) == 100
    for b in buckets:  # a bucket is as shallow as its capacity allows
        assert not b or sum(len(v) for c, v in buckets.items() if c.startswith(b[:-1])) > 3
    assert {r.doc_id for r in exact_dedup.drop_exact_copies(docs).collect()} == set(range(0, 200, 2))
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns


def test_exact_compares_bytes(spark):
    docs = documents(spark, ["aa", "a b", "b a", " a a", "c", None, "ab", ""])
    by_length = lambda norm: F.lpad(F.length(norm).cast("string"), 64, "0")  # noqa: E731  equal for other bytes
    same(exact_dedup.exact_groups(docs, digest=by_length), *oracle(exact_dedup.SQL, docs))


def test_exact_owners_decide(spark):
    """Entries of one text add up in its owner, texts of one digest and digests of one hash stay links of their own."""
    entry = lambda h, d, t, n, c, i: (h, d, t, n, (-c, i, 0))
    rows = [entry(7, "a", "x", 16, 1, 9), entry(7, "a", "x", 3, 2, 5), entry(7, "a", "y", 2, 1, 4), entry(7, "b", "z", 1, 1, 8), entry(1 << 59, "c", None, 1, 1, 1)]
    entries = spark.createDataFrame(rows, "hash long, digest string, norm string, size long, best struct<c:long,doc_id:long,row:long>")
    index = exact_dedup.indexed(entries, 1)
    got = {(r.hash, r.link): (r.digest, r.texts, r.norm, r["size"], r.best.doc_id) for r in index.collect()}
    assert got == {(7, 1): ("a", 2, "x", 19, 5), (7, 2): ("a", 2, "y", 2, 4), (7, 3): ("b", 1, None, 1, 8), (1 << 59, 1): ("c", 1, None, 1, 1)}
    assert len({r.bucket for r in index.collect()}) == 2
    plan = index._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("rangepartitioning(bucket") == 1 and "hashpartitioning" not in plan  # owners work where entries are dealt to


def test_exact_verdicts_are_read_from_the_index(spark, monkeypatch):
    docs = documents(spark, ["same text"] * 70 + ["other", "oth er", "third"])
    same(exact_dedup.exact_groups(docs), *oracle(exact_dedup.SQL, docs))
    whole = exact_dedup.indexed
    monkeypatch.setattr(exact_dedup, "indexed", lambda entries, capacity: whole(entries, capacity).withColumn("size", F.lit(77).cast("long")))
    assert {r.group_size for r in exact_dedup.exact_groups(docs).collect()} == {77}


def test_exact_repeated_rows_stay_once(spark):
    rows = [(2, "same"), (2, "same"), (3, "same"), (2, "other"), (None, "other"), (4, "sa me"), (4, "s ame"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("size", F.lit(2))
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == 8 and sorted((r.keep_id is not None, r.group_size) for r in got if r.kept) == [(False, 2), (True, 1), (True, 5)]
    kept = exact_dedup.drop_exact_copies(docs).collect()
    assert sorted((r.doc_id or 0, r.text and r.text.replace(" ", "")) for r in kept) == [(0, "other"), (4, "same"), (5, None)]


def benchmark_table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").withColumn("doc_id", F.lit(1))


@pytest.mark.parametrize("blocks", [1 << 25, 200])
def test_decontamination_against_sql(spark, blocks):
    docs = documents(spark, hard_texts())
    bench = benchmark_table(spark, [words(40, 2), words(20, 1), None, "", "two words", "one", words(14, 99), words(20, 1)])
    same(decontaminate.scan(docs, bench, block_bytes=blocks), *oracle(decontaminate.SQL, docs, bench))


def test_decontamination_removes(spark):
    passage = words(15, 2)
    docs = documents(spark, [words(500, 8) + " " + passage + " end", passage, None, "clean text"])
    bench = benchmark_table(spark, [passage])
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()] == [0, 2, 3]
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert spans == {0: words(500, 8) + "  end", 1: "", 2: None, 3: "clean text"}
    assert decontaminate.decontaminate(docs, benchmark_table(spark, [])).count() == 4
    assert decontaminate.scan(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("blocks", [1 << 25, 100])
@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontamination_judges_rows_of_one_id_apart(spark, blocks, remove):
    passage = words(15, 2)
    rows = [(1, "clean other text"), (1, passage + " tail one"), (1, passage + " tail one"), (None, passage), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("x")).repartition(3)
    bench = benchmark_table(spark, [passage, words(20, 77), words(20, 78), words(3, 79)])
    got = decontaminate.decontaminate(docs, bench, remove=remove, block_bytes=blocks)
    assert got.columns == docs.columns
    clean = [(1, "clean other text", "x"), (2, None, "x")]
    want = clean if remove == "documents" else [*clean, (1, " tail one", "x"), (1, " tail one", "x"), (None, "", "x")]
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_long_lists_and_balls_lose_no_link(spark):
    rng = np.random.default_rng(3)
    texts = []
    for g in range(3):  # groups of near copies, some of which only a chain connects
        base = [f"g{g}x{i}" for i in range(60)]
        for k in range(40):
            t = list(base)
            for p in rng.choice(60, size=int(rng.integers(0, 4)), replace=False):
                t[p] = f"e{g}-{k}-{p}"
            texts.append(" ".join(t))
    common = words(30, 50)
    texts += [words(15, 100 + k, 10**6) + " " + common + " " + words(15, 300 + k, 10**6) for k in range(60)]  # one passage in many
    docs = documents(spark, texts)
    same(ngram_join.near_duplicates(docs), *oracle(ngram_join.SQL, docs))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[102] == 100


def test_parity_bound():
    rng = np.random.default_rng(0)
    for n, m, common in ((50, 60, 40), (500, 400, 100), (70, 900, 10)):
        c = rng.integers(0, 2**63, common, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([c, rng.integers(0, 2**63, k - common, dtype=np.uint64)])) for k in (n, m))
        x, y = (np.frombuffer(ngram_join.parity(s), np.uint64) for s in (a, b))
        while len(x) != len(y):
            if len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            else:
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_fm_index_finds_what_is_there():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 6, 400), 0)
    index = fm_index.FMIndex(text, 6)
    patterns = np.array([text[i : i + 4] for i in range(300)] + [[5, 5, 5, 0], [1, 0, 1, 1]])
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi, strict=True):
        where = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
        assert sorted(index.sa[a:b].tolist()) == where


def test_matching_statistics_are_longest_matches():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 4, 60)
    segments = sorted({b" ".join(b"%d" % x for x in (base[a : a + m] if k % 2 else rng.integers(0, 4, m))) for k in range(40) for a, m in [(int(rng.integers(0, 40)), int(rng.integers(5, 18)))]})
    owners = rng.integers(0, 9, len(segments)).tolist()
    split = [s.split() for s in segments]
    for own, mine, got in zip(owners, split, substring_dedup.matching_statistics(segments, owners, 5), strict=True):
        want = []
        for e in range(4, len(mine)):
            best = 0
            for other, theirs in zip(owners, split, strict=True):
                if other < own:
                    for f in range(len(theirs)):
                        m = 0
                        while m <= min(e, f) and mine[e - m] == theirs[f - m]:
                            m += 1
                        best = max(best, m)
            want.append(best if best >= 5 else 0)
        assert got.tolist() == want
        covered = {p for e, m in zip(range(4, len(mine)), want, strict=True) for p in range(e - m + 1, e + 1)}
        spans = substring_dedup.intervals(got, 5)
        assert covered == ({p for a, b in np.frombuffer(spans, "<i4").reshape(-1, 2) for p in range(a, b)} if spans else set())


@pytest.mark.parametrize("hot", [1, 3, 1 << 15])
def test_substring_hot_runs_and_small_indexes(spark, hot):
    passage, other = words(40, 2), words(30, 3)
    texts = [words(5 + i, 100 + i) + " " + passage + " " + (other if i % 3 else words(20, 4)) + " " + words(9, 200 + i % 4) for i in range(12)]
    docs = documents(spark, texts + hard_texts()).repartition(3)
    same(substring_dedup.removals(docs, hot_runs=hot, index_words=50), *oracle(substring_dedup.SQL, docs))


def test_substring_repeated_ids(spark):
    passage = words(30, 9)
    rows = [(1, passage), (1, passage), (1, words(20, 1) + " " + passage), (2, passage + " end"), (2, passage + " end"), (None, passage), (0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("anchor", F.lit(1)).withColumn("gone", F.lit("x"))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.removals(docs).collect())
    assert got == [(False, 0, 30, 0), (True, 0, 0, 0), (True, 1, 30, 0), (True, 1, 30, 0), (True, 1, 50, 0), (True, 2, 31, 30), (True, 2, 31, 30)]
    kept = substring_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(["end", "end", "", passage, passage, passage, words(20, 1) + " " + passage])


def test_substring_dedup_keeps_first_copy(spark):
    passage = words(60, 9)
    docs = documents(spark, [words(20, 1) + " " + passage, words(20, 2) + " " + passage + " " + words(5, 3), None])
    kept = {r.doc_id: r.text for r in substring_dedup.drop_repeats(docs).collect()}
    assert kept[0] == words(20, 1) + " " + passage and kept[1] == words(20, 2) + " " + words(5, 3) and kept[2] is None


def token_check(spark, texts):
    tk = Tokenizer.from_file(byte_bpe())
    return [tk.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(spark):
    texts = hard_texts()
    docs = documents(spark, texts).repartition(3)
    folder, manifest = token_files.write_tokens(docs, byte_bpe(), end_id=2)
    rows = sorted(token_files.read_tokens(folder, manifest, with_ids=True).collect())
    at = 0
    for r, ids in zip(rows, token_check(spark, texts), strict=True):
        want = np.array([*ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(want), zlib.crc32(want), want.tolist())
        at += len(want)
    assert token_files.read_tokens(*token_files.write_tokens(docs.limit(0), byte_bpe(), 2)).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_packing_covers_every_id_once(spark, weights):
    texts = [*hard_texts(), *[words(300, 40 + k) for k in range(30)]]
    sources = {i: "abc"[i % 3] if i % 7 else None for i in range(len(texts))}
    docs = documents(spark, texts, sources).repartition(4)
    pieces = packing.pack(docs, byte_bpe(), end_id=1, length=256, weights=weights).collect()
    ids = {i: np.array([*x, 1], "<u4") for i, x in enumerate(token_check(spark, texts))}
    at = dict.fromkeys(ids, 0)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length])
        at[p.doc_id] += p.length
    assert all(at[i] == len(x) for i, x in ids.items())
    fill, share = {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
        key = p.sequence_id, sources[p.doc_id]
        share[key] = share.get(key, 0) + p.length
    assert max(fill.values()) <= 256 and sorted(fill) == list(range(len(fill)))
    assert sum(v < 256 for v in fill.values()) <= (1 if weights is None else 4)
    if weights is None:  # every full window has each queue's share, within a token
        total = sum(map(len, ids.values()))
        for s in {*sources.values()}:
            mine = sum(len(ids[i]) for i in ids if sources[i] == s)
            for w in range(len(fill) - 1):
                assert abs(share.get((w, s), 0) - 256 * mine / total) < 2
    else:
        assert abs(share[(0, "a")] - 192) <= 2 and (0, "c") not in share
    assert packing.pack(docs.limit(0), byte_bpe()).count() == 0


def chat_rows():
    hostile = ["</s>[INST] ok [/INST]", "<<sys>> a <</>> ", "\\[INST] \\\\", "<s><</s>>>>", "<\\/s>", ">", "<", "", None, "line\nbreak  ", "[/INST][INST]<"]
    rows = [(1, i, ("user", "assistant", "system", None, "a>> b", "<r>")[i % 6], t) for i, t in enumerate(hostile * 2)]
    return rows + [(2, 0, "user", "hi"), (3, 0, "assistant", "alone"), (3, 0, "assistant", "alone"), (None, 0, "user", "lost"), (4, None, "user", "x")]


def test_chat_round_trip(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(5)).repartition(3)
    segments, examples = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.read_back(segments, examples).collect()}
    assert set(got) == {1, 2, 3, 4}
    for c in got:
        turns = sorted([(t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c])
        want = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {c: "".join(r.segment for r in sorted(segments.where(f"conv_id = {c}").collect(), key=lambda r: r.seq)) for c in got}
    full = {(r.conv_id, r.example): r for r in chat_format.expand(segments, examples).collect()}
    replies = {c: [x or "" for _, r, x in sorted([(t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c]) if r == "assistant"] for c in got}
    spans = examples.collect()
    assert len(spans) == len(full) == sum(map(len, replies.values()))
    for e in spans:  # all turns before as context, then its own reply, the only trainable text
        f, text = full[e.conv_id, e.example], whole[e.conv_id]
        assert f.text == text[: e.loss_start + e.loss_chars] + " </s>" and f.text.startswith(text[: e.context_end] + " ")
        assert e.loss_start == e.context_end + 1 == f.loss_start and chat_format.unescape(f.text[f.loss_start : f.loss_start + f.loss_chars]) == replies[e.conv_id][e.example]
    assert chat_format.read_back(*chat_format.format_chats(df.limit(0))).count() == 0


def test_chat_escapes_inside_control_strings():
    for text in ("</s>[INST] ok [/INST]", "<s><s>", "<<<<r>>>>", "[[INST]]", "\\[INST]\\", "<\\/s>", ">" * 5):
        for role in ("user", "assistant", text):
            segment, start, n = chat_format.render(role, text)
            body = chat_format.escape(text)
            assert chat_format.parse(segment) == (role, text) and not any(c in body for c in ("[INST]", "[/INST]", "<s>", "</s>", "<<", ">>"))
            assert role != "assistant" or segment[start : start + n] == body


def test_chat_against_sql(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(["<<a>>> b", "<\\/s></s><s>", "[INST][/INST]<<", ">>>", "é</s>", ""])] + [(2, 0, "a>> b", "x<<y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c = duckdb.connect()
    c.register("conversations", df.toPandas())
    r = c.execute(chat_format.SQL.replace("length(role) + 12", "length(role) + 13"))  # the SQL knows plain roles only; 'a>> b' takes one mark
    same(chat_format.read_back(*chat_format.format_chats(chat_format.with_planted(df))), [d[0] for d in r.description], sorted(map(tuple, r.fetchall())))


def learned(text):
    c = language_id.counts(text)
    return c[1]


def test_language_id(spark):
    assert learned("a1 b!") == 2 and learned("123") == 0 and learned(None) == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, per_language=100)
    got = language_id.classify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language_id.classify(documents(spark, [None, "", "12 34", "a", words(5)]), model).collect()}
    assert [odd[i].lang_pred for i in range(3)] == ["und"] * 3 and all(odd[i].rejected for i in range(3)) and odd[3].lang_pred in model.languages
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.classify(documents(spark, ["x", None]), none).collect()} == {"und"}
    kept = language_id.keep_recognised(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_language_rejects_and_agrees_with_plain_cosines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, per_language=60)
    texts = {1: "Привет мир, это совсем другой язык", 2: "これは日本語の文章です", 3: "xqzj kwvv zzqx " * 20, 4: docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 200").orderBy("doc_id").first().text}
    rows = {r.doc_id: r for r in language_id.classify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    assert rows[1].rejected and rows[2].rejected and not rows[4].rejected
    kept = language_id.keep_recognised(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model)
    assert 4 in {r.doc_id for r in kept.collect()} and not {1, 2} & {r.doc_id for r in kept.collect()}
    for i, text in texts.items():  # the centroid of the greatest cosine, by loops
        c = language_id.counts(text)[0]
        v = {k: float(np.log1p(c[k]) * model.idf[k]) for k in np.flatnonzero(c).tolist()}
        cosines = [sum(x * float(row[g]) for g, x in v.items()) / np.sqrt(sum(x * x for x in v.values())) for row in model.centroids]
        best = int(np.argmax(cosines))
        assert rows[i].lang_pred == model.languages[model.owner[best]] and rows[i].rejected == (cosines[best] < model.reach(np.array([language_id.counts(text)[1]]))[0])
    twice = docs.union(docs.withColumn("text", F.lit("other words")))
    again = language_id.fit(twice, per_language=60)
    assert again.centroids.shape == model.centroids.shape


def test_language_centroid_by_hand():
    model = language_id.Model(["a", "b"], np.eye(2, 1 << language_id.BITS, dtype=np.float32), np.array([0, 1]), np.ones(1 << language_id.BITS, np.float32), 0.1)
    assert model.reach(np.array([0, 10**9]))[1] == pytest.approx(0.1)


@pytest.mark.parametrize("weights", [None, {"s7": 3.0, "s8": 1.0}])
def test_packing_has_a_queue_for_every_source(spark, weights):
    texts = [words(60, k) if k < 10 else "one" for k in range(4200)]
    docs = documents(spark, texts, {i: f"s{i}" for i in range(len(texts))}).repartition(4)
    pieces = packing.pack(docs, byte_bpe(), end_id=1, length=128, weights=weights).collect()
    share, size, fill = {}, {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
        share[p.sequence_id, p.doc_id] = p.length + share.get((p.sequence_id, p.doc_id), 0)
        size[p.doc_id] = size.get(p.doc_id, 0) + p.length
    assert len(size) == len(texts) and all(size[p.doc_id] == p.doc_tokens for p in pieces)
    if weights:
        assert abs(share[0, 7] - 96) <= 2 and abs(share[0, 8] - 32) <= 2
    else:
        total = sum(size.values())
        assert all(abs(share.get((w, d), 0) - 128 * n / total) < 2 for d, n in size.items() for w in range(len(fill) - 1))


def test_toxicity_grammar():
    g = toxicity.Grammar({"=idiot": 6.0, "lowei": 6.0, "weak": 2.5}, toxicity.BIAS)
    assert g.score("you idiot") >= 0.7 and g.score("a loweient thing") >= 0.7 and g.score("nothing here") < 0.1 and g.score(None) == g.score("")
    assert g.score("not idiot") < g.score("an idiot") < g.score("you idiot")
    assert g.score("he said: x") == g.score("") and g.score("she said you idiot") < g.score("well, you idiot")
    assert g.score("an id1ot") == pytest.approx(g.score("an idiot")) and g.score("weakness") < 0.7 <= g.score("weakness. weakly. weaker")


def test_toxicity_is_in_clauses():
    g = toxicity.Grammar({"=idiot": 6.0}, toxicity.BIAS)
    assert g.score("idiot") < 0.7 <= g.score("what an idiot") < g.score("you idiot") == g.score("idiot you are")
    for said in ('she said: you idiot', 'she said you idiot', 'he wrote: "you idiot"'):
        assert g.score(said) < g.score("you idiot")
    assert g.score("she said: fine. you idiot") == g.score("you idiot") and g.score("note: you idiot") == g.score("you idiot")
    none = g.score("")
    assert g.score("i will kill you") >= 0.7 and g.score("he will stab them and burn their house") >= 0.7 and none < 0.05
    assert g.score("she said: i will kill you") < g.score("i will kill you")


def test_toxicity_composition_is_the_product():
    rng = np.random.default_rng(0)
    for _ in range(300):
        kinds = rng.integers(0, 8, 7).tolist()
        state, single = toxicity.START, [""] * len(toxicity.GRAMMAR)
        for k in kinds:
            state, factor = toxicity.COMPOSED[state, k]
            want = 1.0
            for i, table in enumerate(toxicity.GRAMMAR):
                if (single[i], k) in table:
                    single[i], f = table[single[i], k]
                    want *= f
            assert list(state) == single and factor == pytest.approx(want)


def test_toxicity_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "you vile man"), (1, "fine"), (1, None), (None, "you vile man")], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = sorted((r.doc_id or 0, r.predicted) for r in toxicity.score(docs, toxicity.Grammar({"=vile": 6.0}, toxicity.BIAS)).collect())
    assert got == [(0, 1), (1, 0), (1, 0), (1, 1)]


def test_toxicity_threats():
    g = toxicity.Grammar({"=idiot": 6.0}, toxicity.BIAS)
    none = g.score("")
    for t in ("I will kill you", "I will k1ll you", "Ich werde dich töten", "je vais te tuer", "te voy a matar"):
        assert g.score(t) >= 0.7 and g.score(f"A quiet day. {t}!") == g.score(t)
    assert none < g.score("I will not kill you") < g.score("he said they will kill you") < 0.7
    assert g.score("you burn wood") == g.score("they beat the eggs") == g.score("we kill time") == none
    harmless = ["Rain can destroy their crops.", "We beat them at chess.", "The sun can burn your skin.", "These pills kill the pain in his back.", "To beat your best time, train daily.", "The virus will kill you.", "You will beat him."]
    assert {g.score(t) for t in harmless} == {none}
    assert min(map(g.score, ["Kill him!", "I'll hurt them all", "we are going to destroy them", "ich werde dich töten"])) >= 0.7
    assert max(map(g.score, ["she said: you idiot", "she said you idiot", 'he said "you are an idiot"', "she said: I will kill you"])) < 0.7 <= g.score("you idiot")
    assert g.score("idiot, I will kill you") > g.score("idiot. I will kill you") > g.score("I will kill you")
    assert g.score("not an id1ot") == g.score("not an idiot") < g.score("you id1ot") == g.score("you idiot")


def test_toxicity_learns(spark):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        t = words(int(rng.integers(5, 80)), i).split()
        if bad:
            for k in range(3):
                t.insert(int(rng.integers(0, len(t))), ["vile", "zorg" + "abcdef"[i // 5 % 6], "zorgx"][k])
        texts.append(" ".join(t))
        labels.append((i, int(bad)))
    docs = documents(spark, [*texts, None, ""])
    tags = spark.createDataFrame([*labels, (None, 1), (9999, 1)], "doc_id long, toxic int")
    grammar = toxicity.fit(docs, tags)
    assert "=vile" in grammar.stems
    rows = {r.doc_id: r for r in toxicity.score(docs, grammar).collect()}
    held = [i for i, _ in labels if rows[i].held_out]
    assert held == [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i].predicted == labels[i][1] for i in held) and rows[300].predicted == rows[301].predicted == 0
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, tags.limit(0))).collect()} == {0}


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>menu {i}</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header>by {i}</header><h1>Head &amp; line {i}</h1><p>First   para<br>of {i}<p><b>second&nbsp;x</b> {i}<aside>side {i}</aside><ul><li>a{i}<li>b{i}</ul>
<p>Share this with everyone</p><div class="comments"><p>nice {i}</p></div><form><p>search</p></form></article><footer>foot {i}</footer></body></html>"""
BARE = """<html><body><div id=top><a href=/>home</a> site name</div><div id=main><p>Always the same line.</p><p>Story {i} has words that differ from page to page, {i} times.</p><p>More of story {i}, all of it plain text.</p></div><div id=low>legal text of the site</div></body></html>"""


def test_html_wrapper(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.replace("{i}", str(i)), "x") for i in range(12)] + [(100 + i, f"https://b.example:80/{i}", BARE.replace("{i}", str(i)), "x") for i in range(12)]
    rows += [(200, "http://c.example/", None, "x"), (201, None, "", "x"), (202, "http://c.example/2", "no tags &lt;here", "x"), (203, "bad", "<p>unclosed <b>bold<p>next", "x")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(got) == len(rows)
    assert got[3].text == "Head & line 3\nFirst para of 3\nsecond x 3\na3\nb3" and got[3].n_chars == len(got[3].text)
    assert got[104].text == "Story 4 has words that differ from page to page, 4 times.\nMore of story 4, all of it plain text."
    assert (got[200].text, got[201].text, got[202].text, got[203].text) == ("", "", "no tags <here", "unclosed bold\nnext")


def test_html_parser_is_linear_on_broken_pages():
    import time

    for broken in ('<a href="x>', "<p title='", '<a b="c>" \'', "<b>", "<li><b>", "</i>", "<a <", "<!-- "):
        times = []
        for n in (4_000, 32_000):
            start = time.process_time()
            html_extract.blocks(html_extract.parse(broken * n + "text"))
            times.append(time.process_time() - start)
        assert times[1] < 24 * times[0] + 0.5, broken
    assert html_extract.blocks(html_extract.parse("a <p title='x>y' b=\"c'd\">one</p> 1 < 2 <p class=it's>two"))[-1][-1] == "two"


def tree(rng, depth=0):
    return html_extract.Node(rng.choice(["p", "div", "ul"]) if depth else "html"), [tree(rng, depth + 1) for _ in range(int(rng.integers(0, 4)) if depth < 4 else 0)]


def linked(t):
    t[0].children = [linked(c) for c in t[1]]
    return t[0]


def heaviest(a, b):
    """Weight of the largest matching of two trees that keeps order and ancestors, by trying all of them."""
    if a.tag != b.tag:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + heaviest(x[0], y[0]))

    return 1 + best(a.children, b.children)


@pytest.mark.parametrize("cells", [1, 1 << 20], ids=["halved tables", "whole tables"])
def test_html_tree_matching_is_the_largest(monkeypatch, cells):
    monkeypatch.setattr(html_extract, "TABLE_CELLS", cells)
    rng = np.random.default_rng(7)
    for _ in range(40):
        ref, page = linked(tree(rng)), linked(tree(rng))
        shapes = {}
        total = html_extract.number(ref, shapes, slots=True)
        html_extract.number(page, shapes)
        html_extract.align(ref, page)
        slots, todo = [], [(page, None)]
        place = {}
        walk = [ref]
        while walk:
            n = walk.pop()
            place[n.slot] = n
            walk.extend(n.children)
        while todo:
            n, above = todo.pop()
            if n.slot >= 0:
                slots.append(n.slot)
                assert place[n.slot].tag == n.tag and (above is None or place[n.slot] in place[above].children)
            todo.extend((c, n.slot) for c in n.children)
            kept = [c.slot for c in n.children if c.slot >= 0]
            assert kept == sorted(kept) and (n.slot >= 0 or not kept)
        assert len(set(slots)) == len(slots) == heaviest(ref, page) <= total


def test_html_alignment_keeps_order():
    ref, page = html_extract.parse("<div><h1>a</h1><p>b</p><p>c</p></div>"), html_extract.parse("<div><p>new</p><h1>a</h1><p>b</p></div>")
    shapes = {}
    html_extract.number(ref, shapes, slots=True)
    html_extract.number(page, shapes)
    html_extract.align(ref, page)
    div = page.children[0]
    assert [c.slot for c in div.children] == [-1, 2, 4] or [c.slot for c in div.children] == [-1, 2, 3]


def test_html_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://a.example/x", PAGE.replace("{i}", "7")) for i in range(10)]
    assert {r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"Head & line 7\nFirst para of 7\nsecond x 7\na7\nb7\nShare this with everyone"}


@pytest.mark.parametrize("name", ["layout no-sidebar", "content with-sidebar", "single comments-open", "social-science", "sidebar", "comments"])
def test_html_names_only_vote(spark, name):
    body = "<p>Story {i} is told <span class='share'>share {i}</span>here at length, number {i}.</p><div class='related'><p>see {i}</p></div>"
    rows = [(i, "http://a.example/x", f"<body><div class='{name}'><article>{body}</article></div></body>".replace("{i}", str(i))) for i in range(6)]
    rows += [(10 + i, "http://b.example/x", f"<body><div class='{name}'>{body}</div></body>".replace("{i}", str(i))) for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k + i: f"Story {i} is told here at length, number {i}." for k in (0, 10) for i in range(6)}


def test_html_keeps_sibling_containers(spark):
    html = "<body><div>constant notice</div><div><div>" + "<p>first {i} " + "long " * 70 + "</p></div><div><p>second {i} " + "more " * 30 + "</p></div></div><div><p>third {i}</p></div></body>"
    rows = [(i, "http://a.example/x", html.replace("{i}", str(i))) for i in range(8)]
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all([x.split(" long")[0].split(" more")[0] for x in got[i]] == [f"first {i}", f"second {i}", f"third {i}"] for i in range(8))


def test_html_templates_of_small_hosts_and_layouts(spark):
    story = "<p>Story {i} is told here, and its number is {i}.</p>"
    one, two = f"<div>Our notice</div>{story}", f"<table><tr><td>{story}</td></tr></table><div class='x'><div>Other notice</div></div>"
    rows = [(i, "http://small.example/", one.replace("{i}", str(i))) for i in range(2)]
    rows += [(100 + i, "http://copies.example/", one.replace("{i}", str(max(i, 30)))) for i in range(36)]
    rows += [(200 + i, "http://layouts.example/", (one, two)[i % 2].replace("{i}", str(i))) for i in range(16)]
    rows += [(300 + i, "http://deep.example/", "<b>" * 90 + one.replace("{i}", str(i))) for i in range(6)]
    long = "The same long report on both pages, but for its number. " * 3
    rows += [(400 + i, "http://near.example/", f"<p>{long}</p><p>number {i}</p>") for i in range(2)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {p: f"{long.strip()}\nnumber {p - 400}" if p >= 400 else "Story {0} is told here, and its number is {0}.".format(max(p - 100, 30) if 100 <= p < 200 else p % 100) for p, _, _ in rows}


def test_words_agree_with_regex():
    text = "Ab c-d\té 12,x\x85y  Z" * 3
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.array([0, 9, len(raw)])
    for table, pattern, fold in ((textarrays.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", textarrays.LOWER), (textarrays.NOT_SPACE, r"[^\x20\x09-\x0D]+", textarrays.SAME)):
        w = textarrays.words(raw, at, table, fold)
        for d in range(2):
            part = raw[at[d] : at[d + 1]].tobytes().decode("utf-8", "surrogateescape")
            if fold is textarrays.LOWER:
                part = re.sub("[A-Z]", lambda m: m[0].lower(), part)
            assert w.counts[d] == len(re.findall(pattern, part))


def test_shared_folder(spark):
    assert shared.shared_dir(spark, "x").startswith("file://")
    assert shared.materialize(spark.range(3), "x").count() == 3
