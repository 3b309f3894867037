"""Which rows each stage of the pipeline must keep, by brute force; scoring over several blocks, slots and buckets."""
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import ctw, packing, quality

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def long_text(seed, n=120):
    return " ".join(f"w{(seed * 7919 + i * i) % 10007}x{seed}" for i in range(n))


def test_language_rejects_what_has_none(spark, docs):
    bare = spark.createDataFrame([(10**6 + i, t, None, "s", 0) for i, t in enumerate([None, "", " \n", "1234 !! 99", "…—"])], DOC)
    kept = STAGE["language"](spark, docs.union(bare), SF).select("doc_id", "text").collect()
    ids = {r.doc_id for r in kept}
    assert not ids & {r.doc_id for r in bare.collect()}
    prose = {r.doc_id for r in docs.collect() if r.lang is not None and len(words(r.text)) >= 60}
    assert len(prose - ids) <= 0.01 * len(prose)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text for r in kept)


def test_quality_keeps_what_the_rules_keep(spark, docs):
    verdict = {r.doc_id: r.kept for r in quality.verdicts(docs).collect()}
    kept = STAGE["quality"](spark, docs, SF).collect()
    assert {r.doc_id for r in kept} == {i for i, k in verdict.items() if k} and 0 < len(kept) < len(verdict)
    texts = {r.doc_id: r.text.split("\n") for r in docs.collect()}
    for r in kept:  # only whole lines leave
        rest = iter(texts[r.doc_id])
        assert all(any(line == other for other in rest) for line in r.text.split("\n"))


def test_near_dedup_keeps_the_least_of_each_group(spark, docs):
    def shingles(text):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    base = long_text(3).split()
    near = [(10**6 + i, " ".join([*base[:60], f"new{i}", *base[61:]]), "en", "s", 1) for i in range(5)] + [(None, " ".join(base), "en", "s", 1), (None, None, None, None, None)]
    rows = docs.union(spark.createDataFrame(near, DOC)).collect()
    sets = {r.doc_id: shingles(r.text) for r in rows if r.doc_id is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    kept = STAGE["near_dedup"](spark, spark.createDataFrame(rows, DOC), SF).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [i for i in ids if find(i) == i]
    assert sum(r.doc_id is None for r in kept) == 2 and len(kept) < len(rows)


def test_spans_leave_all_documents_but_the_first(spark):
    passage = ". ".join(" ".join(f"shared{j}{i}" for i in range(12)) for j in range(6)) + "."
    own = {i: ". ".join(" ".join(f"own{i}{j}{k}" for k in range(12)) for j in range(5)) + "." for i in range(6)}
    rows = [(i, own[i] if i in (0, 5) else f"{own[i]}\n{passage}", "en", "s", 1) for i in range(6)] + [(6, passage, "en", "s", 1), (7, None, None, None, None)]
    got = {r.doc_id: r.text for r in STAGE["span_dedup"](spark, spark.createDataFrame(rows, DOC), SF).collect()}
    assert got[0] == own[0] and got[5] == own[5] and got[1].endswith(passage)
    assert all("shared" not in got[i] and got[i].strip() == own[i] for i in (2, 3, 4))
    assert 6 not in got and 7 not in got


def test_packing_places_every_token_once(spark, docs):
    rows = docs.union(spark.createDataFrame([(10**6, long_text(1, 5000), "en", "s", 1), (10**6 + 1, None, None, None, None)], DOC))
    out = STAGE["packing"](spark, rows, SF).collect()
    size, source = {r.doc_id: len(words(r.text)) + 1 for r in rows.collect()}, {r.doc_id: r.source for r in rows.collect()}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.start, r.n_tokens))
        bins[r.bin_id].append((r.bin_start, r.n_tokens, r.doc_id))
    assert set(pieces) == set(size)
    for i, some in pieces.items():
        assert [s for s, _ in sorted(some)] == [sum(n for _, n in sorted(some)[:k]) for k in range(len(some))] and sum(n for _, n in some) == size[i]
    for some in bins.values():
        some.sort()
        assert [s for s, _, _ in some] == [sum(n for _, n, _ in some[:k]) for k in range(len(some))] and sum(n for _, n, _ in some) <= packing.CAPACITY
        known = [source[i] for _, _, i in some if source[i] is not None]
        assert len(known) == len(set(known))


def test_rows_without_a_key_meet_many_tasks(spark):
    rows = spark.range(600).select(F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("cluster"), (F.col("id") % 200 + 1).alias("n_tokens"))
    out = packing.pack(rows, capacity=256, shard_items=50).collect()
    assert len(out) == 600 and len({r.bin_id.split("-")[0] for r in out}) > 6


def test_the_whole_pipeline_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x" * 50_000, "de", None, 1), (None, long_text(9), "en", "s", 1), (5, "1234 !!", None, "t", 7), (5, "1234 !!", None, "t", 7)]
    prose = "This is a plain sentence about the weather in the north, and it ends here. Another sentence follows it with other words of its own. "
    rows += [(10 + i, "\n".join(f"{prose}The number of this line is {i} and {j}, which makes it differ from all of the other lines." for j in range(4)), "en", f"s{i}", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, DOC)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert not {1, 2, 5} & {r.doc_id for r in docs.collect()}
    empty = spark.createDataFrame([], DOC)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


CLASHING = "doc_id long, text string, key string, training string, block string, slot long, t string"


def test_scores_do_not_depend_on_blocks_slots_or_buckets(spark, docs, monkeypatch):
    odd = [(None, "a null id", "k", "t", "b", 1, "t"), (7, "one id twice", "k", "t", "b", 1, "t"), (7, "one id twice", "k", "t", "b", 1, "t"), (8, None, None, None, None, None, None), (9, "long text with words " * 70_000, "k", "t", "b", 1, "t")]
    rows = docs.select("doc_id", "text").withColumns({"key": F.lit("k"), "training": F.lit("t"), "block": F.lit("b"), "slot": F.lit(1).cast("long"), "t": F.lit("t")}).unionByName(spark.createDataFrame(odd, CLASHING))
    teaches = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))
    plain = lambda df: sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())
    whole = plain(ctw.score(rows.coalesce(1), teaches))
    monkeypatch.setattr(ctw, "SLOT_BYTES", 100_000)
    monkeypatch.setattr(ctw, "BUCKET_GRAMS", 20_000)
    apart = plain(ctw.score(rows.repartition(6), teaches))
    assert len(whole) == rows.count() and [x[:4] for x in whole] == [x[:4] for x in apart]
    assert all(abs(a[4] - b[4]) < 1e-4 and abs(a[5] - b[5]) < 1e-4 * max(1, abs(a[5]) / 1000) for a, b in zip(whole, apart))
