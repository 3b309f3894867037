"""The corpus operators against brute force, round trips and held-out accuracy, with nulls, empties, repeats and empty tables."""
import base64
import hashlib
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import bottomk, bpe, components, ctw, langmix, packing, quality, queries, spans, warc, webp, wrappers

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, _sw_text string, words string"
EDGES = [
    (1, None, None, None, None, "z", "w"), (2, "", "en", "s", 0, None, None), (3, " \n\t", "en", "s", 3, "z", "w"), (4, "a b c", "en", "s", 5, "z", "w"), (4, "a b c", "en", "s", 5, "z", "w"),
    (5, "x" * 50_000, "de", None, 50_000, "z", "w"), (6, "one two three four five six seven. " * 40, "en", "s", 1400, "z", "w"), (7, "1234 !!", None, "t", 7, "z", "w"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOC)


@pytest.fixture(scope="module")
def nothing(edges):
    return edges.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_base(spark, docs, edges):
    both = docs.select("doc_id", "text").union(edges.select(F.col("doc_id") + 10**6, "text"))
    got = {r.doc_id: r for r in quality.verdicts(both).collect()}
    exact = {r.doc_id: r.n_repeat_words for r in quality.measured(both.withColumnRenamed("text", "t"), "t", whole_path=True).select("doc_id", "n_repeat_words").collect()}
    for r in both.collect():
        w = words(r.text)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for j in (i, i + 1, i + 2)}
        solid = [x for x in (r.text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(solid) - len(set(solid)), len(covered))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert exact[r.doc_id] == len(covered)
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_clean_keeps_columns(spark, nothing):
    good = "This is a clean sentence with enough words to stay here. " * 20
    varied = " ".join(f"{w}{i}" for i, w in enumerate(good.split())) + "."
    df = spark.createDataFrame([(1, varied + "\nhome | about | shop | cart", "en", "s", 9, None, None), (2, None, None, None, None, None, None)], DOC)
    out = quality.clean(df).collect()
    assert [r.doc_id for r in out] == [1] and out[0].text == varied and out[0].n_chars == len(varied)
    assert quality.clean(df).columns == df.columns and quality.clean(nothing).count() == 0


def test_bpe_equals_the_library(spark, docs, edges, nothing):
    tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(path))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    odd = [("".join(rnd.choice("aab \n\t é漢\x1c　1<|!") for _ in range(rnd.randrange(80))),) for _ in range(300)] + [("aaaaaaa" * 99,), ("  a  b",)]
    texts = docs.select("text").union(edges.select("text")).union(spark.createDataFrame(odd, "text string")).withColumn("doc_id", F.monotonically_increasing_id())
    for r in texts.join(bpe.encoded(texts, path, tokenizers.PATTERN), "doc_id").collect():
        assert r.ids == library.encode_ordinary(r.text or "")
    for r in texts.join(bpe.digests(texts, path, tokenizers.PATTERN), "doc_id").collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode_ordinary(r.text or ""))).encode()).hexdigest()
    assert bpe.digests(nothing, path, tokenizers.PATTERN).count() == 0


def brute_components(rows):
    sets, parent = {}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, t in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        parent[k] = k
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in keys}, {k: len(s) for k, s in sets.items()}


def near_copies(seed, n, words_each, edits):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(words_each)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(10**6)}"
        yield " ".join(copy)


def test_near_duplicates_equal_brute_force(spark, docs, edges, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6 + r.doc_id, r.text) for r in edges.collect()]
    rows += [(10**7 + i, t) for i, t in enumerate([*near_copies(1, 90, 150, 9), *near_copies(2, 30, 80, 3), *near_copies(3, 60, 12, 2)])]
    got = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want, sizes = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)
    assert bottomk.near_duplicates(nothing).count() == 0


def test_near_duplicates_share_a_passage_with_many_documents(spark):
    rnd = random.Random(11)
    some = lambda n: [f"p{rnd.randrange(10**7)}" for _ in range(n)]
    rows = []
    for passage, own in ((100, 60), (110, 44), (120, 30), (130, 20)):
        shared = some(passage)
        for _ in range(50):
            # two copies of one text and its passage, each with words of its own: 0.75 to 0.80 of the union is shared
            common = shared + some(own)
            edits = rnd.randrange(len(common) * 125 // 1000, len(common) * 160 // 1000 + 1)
            rows += [(len(rows) + i, " ".join(common + some(edits))) for i in range(2)]
    got = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want, _ = brute_components(rows)
    assert sum(want[k] != k for k in want) > 100
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("pivots", [0, 2])
def test_near_duplicates_of_a_crowd_in_blocks(spark, monkeypatch, pivots):
    """A crowd of near copies costs a row a member and list, not one for each pair of blocks; no link is lost, with no pivots either."""
    monkeypatch.setattr(bottomk, "BLOCK_DOCS", 40)
    monkeypatch.setattr(bottomk, "PIVOTS", pivots)
    plain, counts = bottomk._forests, []

    def counted(met, *rest):
        counts.append((met.count(), met.select("rep", "value").distinct().count()))
        return plain(met, *rest)

    monkeypatch.setattr(bottomk, "_forests", counted)
    # near copies that mostly link, and a crowd around one passage of which few link
    rnd = random.Random(5)
    rows = list(enumerate(near_copies(4, 400, 100, 2)))
    rows += [(10_000 + i, t) for i, t in enumerate(near_copies(6, 160, 120, 5))]
    shared = [f"s{rnd.randrange(10**6)}" for _ in range(60)]
    rows += [(20_000 + i, " ".join(shared + [f"o{rnd.randrange(60)}" for _ in range(rnd.randrange(8, 40))])) for i in range(160)]
    got = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want, _ = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    met, entered = counts[0]
    assert entered > 1000 and met <= (1.5 if pivots else 1) * entered
    assert len(counts) == 2  # strays of the passage have met the others


@pytest.mark.parametrize("shown", [0, 12])
def test_near_duplicates_of_a_crowd_that_does_not_link(spark, monkeypatch, shown):
    """Members around one text or one passage that do not link meet by what else they share, never all by all; the few links among them are found."""
    monkeypatch.setattr(bottomk, "BLOCK_DOCS", 20)
    monkeypatch.setattr(bottomk, "SHOWN", shown)
    plain, counts = bottomk._forests, []

    def counted(met, *rest):
        counts.append((met.count(), met.select("rep").distinct().count()))
        return plain(met, *rest)

    monkeypatch.setattr(bottomk, "_forests", counted)
    rnd = random.Random(9)
    new = lambda n: [f"n{rnd.randrange(10**8)}" for _ in range(n)]
    rows = list(enumerate(near_copies(12, 120, 110, 6)))
    passage = new(70)
    for i in range(240):
        text = passage + new(rnd.randrange(20, 60))
        rows.append((1000 + i, " ".join(text)))
        if i % 12 == 0:  # a text of its own linked with this one, by more than the passage
            rows.append((2000 + i, " ".join(text[:-2] + new(2))))
    got = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want, _ = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert sum(want[2000 + i] == 1000 + i for i in range(0, 240, 12)) == 20
    (_, members), (met, _) = counts
    assert members > 300 and met <= 4 * members


def test_near_duplicates_verify_pairs_without_holding_batches(spark):
    """Pairs are verified row by row: sets never gather in a batch beside the heap."""
    sets = spark.createDataFrame([(1, list(range(100))), (2, list(range(14, 114))), (3, list(range(15, 115)))], "rep long, shingles array<long>")
    linked = bottomk._verified(spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long"), sets, 75)
    assert sorted(map(tuple, linked.collect())) == [(1, 2), (2, 3)]
    assert "Arrow" not in linked._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_keep_null_ids(spark):
    import corpus_pipeline

    rows = [(5, "a b c d e f g", "en", "s", 13), (None, "a b c d e f g", "en", "s", 13), (None, "own words", None, "s", 9), (6, "a b c d e f g", "en", "t", 13), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in bottomk.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3, 5, True), (6, 3, 5, False), (None, 3, None, True), (None, 1, None, True), (None, 0, None, True)], key=str)
    left = corpus_pipeline.near_dedup(spark, df, SF)
    assert left.columns == df.columns and sorted(map(tuple, left.collect()), key=str) == sorted([r for r in rows if r[0] != 6], key=str)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def brute_parts(text):
    """[(sentence, [words])], by the rules of the docstring, word by word."""
    import xxhash

    out, number = [], 0
    for line in (text or "").split("\n"):
        sentence = []
        found = [w.encode().lower() for w in words(line)]
        for i, w in enumerate(found):
            sentence.append(w)
            if i == len(found) - 1 or re.search(rb"[.!?][\"')\]]*$", w):
                cuts = {len(sentence)}
                if len(sentence) > 8:
                    order = [(xxhash.xxh3_64_intdigest(x) >> 24, -k) for k, x in enumerate(sentence)]
                    cuts |= {1 - min(order[k : k + 8])[1] for k in range(len(sentence) - 7)}
                cuts = [0, *sorted(cuts)]
                out += [(number, sentence[a:b]) for a, b in zip(cuts, cuts[1:])]
                number, sentence = number + 1, []
    return out


def brute_spans(listed):
    """{(first part, part after the last): words}"""
    out = {}
    run = lambda a, b: [w for _, x in listed[a:b] for w in x]
    for a in range(len(listed)):
        for b in range(a + 3, len(listed) + 1):
            if len(run(a, b)) >= 16:
                out[a, b] = tuple(run(a, b))
                break
    if len(listed) < 3:
        return {(0, len(listed)): tuple(run(0, len(listed)))} if len(run(0, len(listed))) >= 16 else {}
    for a in range(len(listed) - 3, -1, -1):
        if len(run(a, len(listed))) >= 16:
            out[a, len(listed)] = tuple(run(a, len(listed)))
            break
    return out


def brute_strip(rows):
    """{row number: (words left, removals)} for (id, text) rows."""
    known, out = {}, {}
    for i, (k, t) in enumerate(rows):
        if k is not None:
            for run in brute_spans(brute_parts(t)).values():
                known.setdefault(run, set()).add(k)
    for i, (k, t) in enumerate(rows):
        listed = brute_parts(t)
        covered, own = set(), set()
        for (a, b), run in sorted(brute_spans(listed).items()):
            if run in own or (k is not None and min(known[run]) < k):
                covered |= set(range(a, b))
            own.add(run)
        of = {}
        for j, (n, _) in enumerate(listed):
            of.setdefault(n, []).append(j)
        whole = [n for n, js in of.items() if set(js) <= covered]
        gone = {j for n in whole for j in of[n]}
        lone = {j for n, js in of.items() if n not in whole and sum(len(listed[j][1]) for j in js) > 60 for j in js if j in covered}
        j = 0
        while j < len(listed):
            run = []
            while j in covered:
                run.append(j)
                j += 1
            if run and not set(run) & (gone | lone):
                lone |= set(run)
            j += 1
        out[i] = ([w for j, (_, x) in enumerate(listed) if j not in gone | lone for w in x], len(whole) + len(lone))
    return out


def check_spans(spark, rows, kind="long"):
    numbered = [(i, k, t) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(numbered, f"row long, doc_id {kind}, text string").repartition(3)
    got = spans.strip_repeats(df).collect()
    want = brute_strip(rows)
    assert len(got) == len(rows)
    for r in got:
        assert ([w.encode().lower() for w in words(r.text)], r.n_removed) == want[r.row], r.row
        if not r.n_removed:
            assert r.text == rows[r.row][1]
    return want


def test_spans_equal_brute_force(spark, docs, edges, nothing):
    rows = [(r.doc_id, r.text) for r in docs.filter("length(text) < 6000").collect()] + [(10**6 + r.doc_id, r.text) for r in edges.filter("length(text) < 6000").collect()]
    rnd = random.Random(5)
    some = lambda n, kinds, marks: " ".join(f"v{rnd.randrange(kinds)}" + rnd.choice(marks) for _ in range(n))
    for marks in (("", "", "", "", "", "."), ("",) * 24 + (".",), ("",), ("", "", ".", "\n")):
        passage = some(60, 10**6, marks)
        rows += [(2 * 10**6 + len(rows), f"{some(rnd.randrange(50), 10**6, marks)} {passage} {some(rnd.randrange(40), 10**6, marks)}") for _ in range(4)]
        rows += [(2 * 10**6 + len(rows), some(200, 3, marks)), (None, passage), (None, f"{passage} {passage}"), (2 * 10**6, passage)]
    want = check_spans(spark, rows)
    assert sum(n > 0 for _, n in want.values()) > 30
    check_spans(spark, [(k if k is None else f"id {k:09d}", t) for k, t in rows if k is None or k >= 10**6], "string")
    clashing = edges.withColumns({"n_removed": F.lit(1), "key": F.lit(2), "parts": F.lit(3), "span": F.lit(4)})
    got = spans.strip_repeats(clashing)
    assert set(got.columns) == set(clashing.columns) and got.count() == edges.count()
    assert spans.strip_repeats(nothing).count() == 0


def test_sentences_go_whole(spark):
    """In prose with marks nothing is cut inside a sentence."""
    rnd = random.Random(9)
    sentence = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(6, 30))) + "."
    shared = [sentence() for _ in range(6)]
    rows = [(i, " ".join([*(own := [sentence() for _ in range(5)])[:3], *shared, *own[3:]])) for i in range(20)]
    out = {r.doc_id: r for r in spans.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        kept = [x for x in re.split(r"(?<=\.) ", t) if x not in re.split(r"(?<=\.) ", out[i].text)]
        assert set(re.split(r"(?<=\.) ", out[i].text)) <= set(re.split(r"(?<=\.) ", t))
        assert set(kept) <= set(shared) and (not kept) == (i == 0) and (i == 0 or len(kept) >= 5)


def test_planted_passage_goes(spark):
    rnd = random.Random(3)
    some = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    passage = some(60)
    df = spark.createDataFrame([(1, f"{some(80)} {passage} {some(20)}"), (2, f"{some(30)} {passage} {some(90)}"), (3, some(150))], "doc_id long, text string")
    out = {r.doc_id: r.text for r in spans.strip_repeats(df).collect()}
    assert passage in out[1] and len(out[3].split()) == 150 and len(out[2].split()) < 150


def test_every_passage_of_47_words_holds_a_span(spark):
    rnd = random.Random(17)
    some = lambda n, kinds, marks: " ".join(f"u{rnd.randrange(kinds)}" + "." * (rnd.random() < marks) for _ in range(n))
    rows, passages = [], []
    for i in range(900):
        marks = (0, 0.02, 0.05, 0.1, 0.3)[i % 5]
        passages.append(some(47, (1, 2, 3, 10, 50, 10**6)[i % 6], marks))
        rows += [(2 * i, f"{some(40, 10**9, marks)} {passages[-1]} {some(20, 10**9, marks)}"), (2 * i + 1, f"{some(25, 10**9, marks)} {passages[-1]} {some(33, 10**9, marks)}")]
    out = {r.doc_id: r.text for r in spans.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, passage in enumerate(passages):
        codes = []
        for _, t in rows[2 * i : 2 * i + 2]:
            h, starts, ends, _ = spans.parts(t)
            codes.append(set(spans.spans(h, starts, ends)[0].tolist()))
        assert codes[0] & codes[1]
        assert passage not in out[2 * i + 1]


@pytest.mark.parametrize("word", ["a", "b", "c", "d", "e", "f"])
def test_whole_copies_of_few_words_go(spark, word):
    df = spark.createDataFrame([(1, f"{word} " * 16), (2, f"{word} " * 16)], "doc_id long, text string")
    assert {r.doc_id: r.text.split() for r in spans.strip_repeats(df).collect()} == {1: [word] * 16, 2: []}


def test_packing(spark, docs, edges, nothing):
    both = docs.select("doc_id", "text", "source").union(edges.select(F.col("doc_id") + 10**6, "text", "source"))
    rows = packing.pack_documents(both, 300).collect()
    info = {r.doc_id: r for r in both.collect()}
    assert sum(r.n_tokens for r in rows) == sum(len(words(r.text)) + 1 for r in both.collect())
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        if members[0].bin_id.startswith("w-"):
            continue
        assert sum(r.n_tokens for r in members) <= 300
        names = [info[r.doc_id].source for r in members if info[r.doc_id].source is not None]
        texts = [" ".join(words(info[r.doc_id].text)).lower() for r in members]
        assert len(names) == len(set(names)) and len(texts) == len(set(texts))
        at = sorted((r.bin_start, r.n_tokens) for r in members)
        assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    assert packing.pack_documents(nothing).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    bins, at = packing.best_fit([6, 5, 4, 3], ["a", "b", "a", "b"], [1, 2, 3, 4], 10)
    assert bins == [0, 1, 1, 0] and at == [0, 0, 5, 6]


def test_best_fit_equals_trying_every_bin():
    rnd = random.Random(4)
    for _ in range(200):
        items = sorted(((rnd.randrange(1, 60), rnd.choice("abcd"), rnd.randrange(8)) for _ in range(40)), reverse=True)
        room, inside, want = [], [], []
        for size, source, cluster in items:
            fits = [b for b in range(len(room)) if room[b] >= size and not any(s == source or c == cluster for s, c in inside[b])]
            best = min(fits, key=lambda b: (room[b], b), default=len(room))
            if best == len(room):
                room.append(60), inside.append([])
            room[best] -= size
            inside[best].append((source, cluster))
            want.append(best)
        assert packing.best_fit(*map(list, zip(*items)), 60)[0] == want


def test_packing_keeps_near_copies_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{base} x{i}" if i < 6 else f"own{i} text", f"s{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = packing.pack_documents(df, 400, clusters=bottomk.near_duplicates(df)).collect()
    assert len(near) == 12 and len({r.bin_id for r in near if r.doc_id < 6}) == 6
    assert len({r.bin_id for r in packing.pack_documents(df, 400).collect()}) < 6


def test_language_letters(spark):
    rows = [(1, "😀🎉 🚀"), (2, "𐐀𐐁𐐂 𐐃𐐄"), (3, "12 ́̂ 34"), (4, "हिन्दी भाषा"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = langmix.learn(df.filter("doc_id in (2, 4)").withColumn("lang", F.when(F.col("doc_id") == 2, "dsrt").otherwise("hi")))
    assert {r.doc_id: r.lang_pred for r in langmix.predict(df, model).collect()} == {1: "und", 2: "dsrt", 3: "und", 4: "hi", 5: "und"}
    assert len(langmix.trigrams("हिन्दी")) == 6  # marks belong to their word
    with pytest.raises(TypeError):
        bottomk.near_duplicates(df.withColumn("doc_id", F.lit("x")))


def brute_mixture(text, model):
    """The proportions of the best penalised set of languages, trying every set, with many small steps."""
    import itertools
    import math

    names, table = model
    grams = langmix.trigrams(text).tolist()
    best = None
    for size in range(1, len(names) + 1):
        for chosen in itertools.combinations(range(len(names)), size):
            share = {k: 1 / size for k in chosen}
            for _ in range(300):
                new = dict.fromkeys(chosen, 0.0)
                for g in grams:
                    part = {k: share[k] * math.exp(table[k][g]) for k in chosen}
                    for k in chosen:
                        new[k] += part[k] / sum(part.values()) / len(grams)
                share = new
            fit = sum(math.log(sum(share[k] * math.exp(table[k][g]) for k in chosen)) for g in grams) - 0.5 * size * math.log(len(grams) + 1)
            if best is None or fit > best[0]:
                best = fit, {names[k]: share[k] for k in chosen}
    return best[1]


def test_language_equals_trying_every_set(spark, docs):
    model = langmix.learn(docs)
    texts = [r.text[:250] for r in docs.filter("lang is not null and length(text) > 250").orderBy("doc_id").limit(6).collect()]
    texts += [texts[0][:120] + " " + texts[1][:120]]
    got = langmix.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        want = brute_mixture(texts[r.doc_id], model)
        assert {x.lang for x in r.languages} == set(want)
        assert all(abs(x.share - want[x.lang]) < 0.05 for x in r.languages)


def test_language(spark, edges, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op7_language_mixture(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("held_out and n_chars > 100")
    assert out.filter("lang_pred = lang").count() >= 0.97 * out.count()
    model = langmix.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langmix.predict(edges, model).collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0)
    assert langmix.predict(edges, langmix.learn(nothing)).filter("lang_pred <> 'und'").count() == 0
    mixed = docs.filter("lang = 'en' and n_chars > 1500").first().text + " " + docs.filter("lang = 'de' and n_chars > 1500").first().text
    shares = {x.lang: x.share for x in langmix.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first().languages}
    assert {"en", "de"} <= set(shares)
    assert langmix.clear_only(edges, model, 0.4).columns == edges.columns


def brute_ctw(train, text, depth):
    """The weights of all nodes by definition, then the log10 probability of the text."""
    import math

    counts = {}
    edge = [255] * depth
    for t in train:
        x = edge + list(t) + [255]
        for i in range(depth, len(x)):
            for d in range(depth + 1):
                ctx = tuple(x[i - d : i])
                for k in range(8):
                    node = (ctx, (1 << k) | (x[i] >> (8 - k)))
                    counts.setdefault(node, [0, 0])[(x[i] >> (7 - k)) & 1] += 1
    below = {}
    weight = {}
    for ctx, pre in sorted(counts, key=lambda n: -len(n[0])):
        a, b = counts[ctx, pre]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        s = below.get((ctx, pre), 0.0)
        if len(ctx) == depth:
            total, weight[ctx, pre] = own, 1.0
        else:
            top = max(own, s)
            total = top + math.log(math.exp(own - top) + math.exp(s - top)) - math.log(2)
            weight[ctx, pre] = 1 / (1 + math.exp(min(700, s - own)))
        if ctx:
            below[ctx[1:], pre] = below.get((ctx[1:], pre), 0.0) + total
    x, out = edge + list(text) + [255], 0.0
    for i in range(depth, len(x)):
        for k in range(8):
            p, bit, pre = None, (x[i] >> (7 - k)) & 1, (1 << k) | (x[i] >> (8 - k))
            for d in range(depth, -1, -1):
                node = (tuple(x[i - d : i]), pre)
                if node in counts:
                    own = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
                    p = own if p is None else weight[node] * own + (1 - weight[node]) * p
            out += math.log10(0.5 if p is None else p)
    return out


def test_context_trees_equal_their_definition(spark, nothing):
    texts = ["the cat sat on the mat", "The cat", None, "", "ab" * 30, "the cat sat on the mat", "zébra ünd mat", "mat the on sat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in ctw.score(df, F.col("doc_id") < 5).collect()}
    train = [(t or "").lower().encode() for t in texts[:5]]
    import math

    c = Counter(w for t in train for w in t.split())
    c["<end>"] = 5
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        raw = "".join(x.lower() if x < "\x80" else x for x in t or "").encode()
        assert out[i].score == pytest.approx(brute_ctw(train, raw, ctw.DEPTH), abs=1e-5)
        assert out[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*raw.split(), "<end>"]))
        assert (out[i].n_tokens, out[i].train_tokens) == (len(raw.split()) + 1, n)
    assert ctw.score(nothing, F.lit(True)).count() == 0


def test_wrapper(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=1>menu</a></nav><div class='cookie-notice'>cookies</div><article><h1>Head &amp; tail</h1>{}</article><aside>side</aside><div id=comments><p>said</p></div><footer>f</footer></body>"
    rows = [(i, "http://h.example.org/x", page.format("".join(f"<p>Text {j}\n &lt;b&gt;<b>bold</b>" for j in range(i)))) for i in range(6)]
    rows += [(7, None, None), (8, "http://h.example.org/y", ""), (9, "odd", "<p>only <script>no</script>this"), (9, "odd", "<p>only <script>no</script>this")]
    out = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    for i in range(6):
        assert got[i] == "\n".join(["Head & tail", *[f"Text {j} <b>bold" for j in range(i)]])
    assert (got[7], got[8]) == ("", "") and got[9].split() == ["only", "this"]
    assert "(<p> #TEXT </p>)+" in wrappers.expression(wrappers.learned(wrappers.tree("<p>a<p>b<p>c")))


@pytest.mark.parametrize(("body", "want"), [
    ("<article><p><a href=1>By the same author</a></p><h2>H{0}</h2><p>First text {0}.</p><div>Middle {0}.</div><p>Last text {0}.</p></article>", "H{0}\nFirst text {0}.\nMiddle {0}.\nLast text {0}."),
    ("<div><a href=1>home</a> <a href=2>shop</a></div><h1>H{0}</h1><div>The article {0}.</div>", "H{0}\nThe article {0}."),
    ("<article><ul><li><a href=1>related</a><li><a href=2>more</a></ul><p>Text {0}.</p><ul><li>own {0}<li>list</ul></article>", "Text {0}.\nown {0}\nlist"),
])
def test_wrapper_judges_slots_apart(spark, body, want):
    rows = [(i, "http://h.example.org/x", f"<html><body>{body.format(i)}</body></html>") for i in range(5)]
    out = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: want.format(i) for i in range(5)}


@pytest.mark.parametrize("names", [
    "class='ad-300x250'", "class='sidebar2'", "class='widget-3'", "id='comments-17'", "class='col box wide advert'", f"class='{'x' * 60} {'y' * 30} share'", "class='a b c d e' id=post role=x class2=y data-z='1' id='newsletter-9'",
])
def test_wrapper_reads_every_name(spark, names):
    rows = [(i, "http://h.example.org/x", f"<body><div class='col box wide text'><p>Text {i}</p></div><div {names}><p>Not text {i}</p></div><div class='one two three main'><p>More {i}</p></div></body>") for i in range(4)]
    out = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"More {i}" for i in range(4)}
    rows = [(i, u, h.replace("three main", "three")) for i, u, h in rows]
    out = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"Text {i}\nMore {i}" for i in range(4)}


def test_wrapper_keeps_articles_about_adverts():
    assert wrappers.tree("<article class='post type-post status-publish tag-ads category-social'>x").parts[0].key == "article post type-post status-publish"


def extracted(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_wrapper_tells_the_template_from_the_article(spark):
    """What only the other pages of a host can tell: the one-page wrapper keeps the sentence that all pages have."""
    page = lambda i: f"<body><article><h1>Head {i}</h1><p>Story {i} of the day.</p><p>Middle {i}.</p><div>Send us your own story today.</div><section><p>End {i}.</p></section></article></body>"
    rows = [(i, "http://h.example.org/x", page(i)) for i in range(12)]
    want = {i: f"Head {i}\nStory {i} of the day.\nMiddle {i}.\nEnd {i}." for i in range(12)}
    assert extracted(spark, rows) == want
    alone = wrappers.article(wrappers.tree(page(3)), wrappers.slots(wrappers.learned(wrappers.tree(page(3)))))
    assert alone == "Head 3\nStory 3 of the day.\nMiddle 3.\nSend us your own story today.\nEnd 3."
    # copies of one page, and few different pages, are no template
    assert extracted(spark, [(i, "http://h.example.org/x", page(3)) for i in range(12)]) == {i: alone for i in range(12)}
    limit, wrappers.BROADCAST_BYTES = wrappers.BROADCAST_BYTES, 0
    try:
        assert extracted(spark, rows) == want
    finally:
        wrappers.BROADCAST_BYTES = limit


def test_wrapper_stands_odd_pages(spark):
    import time

    odd = [
        "<div>" * 1200 + "deep" + "</div>" * 1200, "<div>" * 1200 + "<nav>menu</nav><p class='share'>no</p>said", "<a " * 8000, "<p " * 8000 + "<", "x<a href=\"y>open quote</a> z", "a < b <> c <3 d",
        "".join(f"<div class='k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>t{i}</div>" for i in range(20_000)), "</div>" * 9000 + "<p>late", "<ul>" + "<li>x<ul>" * 3000, "<!--" * 5000, "<script>" * 3000, "word " * 200_000,
    ]
    began = time.time()
    got = extracted(spark, [(i, "http://h.example.org/x", h) for i, h in enumerate(odd)] + [(100 + i, f"http://h{i}.example.org/x", h) for i, h in enumerate(odd)])
    assert time.time() - began < 60
    for base in (0, 100):
        assert got[base] == "deep" and got[base + 1] == "said"
        assert got[base + 5] == "a < b <> c <3 d" and got[base + 7] == "late" and len(got[base + 11].split()) == 200_000
        assert got[base + 6].split() == [f"t{i}" for i in range(20_000)]
    assert got[104] == "xopen quote z"


def brute_wrapper(pages):
    """The blocks that all pages of a host have in common, in order, by trying every subsequence of the first page."""
    import itertools

    keys = [[p.key for p in wrappers.tree(h).parts] for h in pages]

    def holds(some, whole):
        rest = iter(whole)
        return all(k in rest for k in some)

    for size in range(len(keys[0]), -1, -1):
        for some in itertools.combinations(keys[0], size):
            if all(holds(some, k) for k in keys):
                return list(some)


def test_wrapper_equals_brute_force_on_small_hosts():
    """An optional block between any two required ones: what all pages share is required, all else optional, in the pages' order."""
    rnd = random.Random(21)
    for _ in range(60):
        names = ["h1", "div", "p", "ul", "section", "table", "h2"]
        pages = ["".join(f"<{n}>x{rnd.random()}</{n}>" for i, n in enumerate(names) if i % 2 == 0 or rnd.random() < 0.6) for _ in range(4)]
        whole = None
        for h in pages:
            own = wrappers.learned(wrappers.tree(h))
            whole = own if whole is None else wrappers.aligned(whole, own)
        required = [c[0] for c in whole[wrappers.BELOW] if c[wrappers.SEEN] == 4]
        assert required == brute_wrapper(pages)
        for h in pages:
            own = [p.key for p in wrappers.tree(h).parts]
            assert [k for k in (c[0] for c in whole[wrappers.BELOW]) if k in own] == own


def encode_fully(pixels, cache_bits=4, tile=2):
    """Writes every feature of the format: predictor, cross colour, subtract green, two entropy groups, references, cache."""
    height, width = pixels.shape
    flat = pixels.reshape(-1).astype(np.uint32)
    w = webp.start(width, height)
    across, down = -(-width >> tile), -(-height >> tile)

    def literal(image):
        w.put(0, 1)
        columns = [(image >> s) & 255 for s in (8, 16, 0, 24)]
        codes = [np.bincount(c, minlength=n).tolist() for c, n in zip(columns, (280, 256, 256, 256), strict=True)]
        lengths = [webp.code_lengths(c) for c in codes]
        for n in lengths:
            webp.put_code(w, n)
        webp.put_code(w, [1] + [0] * 39)
        tables = [webp._canonical(n) for n in lengths]
        for values in zip(*columns, strict=True):
            for t, v in zip(tables, values, strict=True):
                w.put(*t[int(v)])

    modes = ((np.arange(across * down) % 14) << 8).astype(np.uint32)
    factors = np.full(across * down, (7 << 16) | (250 << 8) | 9, np.uint32)
    for kind, table in ((0, modes), (1, factors)):
        w.put(1, 1), w.put(kind, 2), w.put(tile - 2, 3)
        literal(table)
    w.put(1, 1), w.put(2, 2), w.put(0, 1)
    flat = webp._predicted(flat, width, modes, tile, -1)
    flat = webp._crossed(flat, width, factors, tile, -1)
    flat = webp._green(flat, -1)
    tokens, cache, at = [], [None] * (1 << cache_bits), 0
    while at < len(flat):
        run = 0
        while at + run < len(flat) and at and flat[at + run] == flat[at - 1]:
            run += 1
        slot = ((webp._CACHE_FACTOR * int(flat[at])) & 0xFFFFFFFF) >> (32 - cache_bits)
        step = 1
        if run >= 3:
            step = min(run, 4)
            tokens.append((at, "copy", step))
        elif cache[slot] == flat[at]:
            tokens.append((at, "cache", slot))
        else:
            tokens.append((at, "pixel", int(flat[at])))
        for v in flat[at : at + step]:
            cache[((webp._CACHE_FACTOR * int(v)) & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        at += step
    w.put(1, 1), w.put(cache_bits, 4), w.put(1, 1), w.put(tile - 2, 3)
    group = (np.arange(across * down) % 2).astype(np.uint32)
    literal(group << 8)
    of = lambda i: int(group[(i // width >> tile) * across + (i % width >> tile)])
    counts = [[[0] * n for n in (280 + (1 << cache_bits), 256, 256, 256, 40)] for _ in range(2)]
    for i, kind, v in tokens:
        c = counts[of(i)]
        if kind == "pixel":
            for j, s in enumerate((8, 16, 0, 24)):
                c[j][(v >> s) & 255] += 1
        elif kind == "cache":
            c[0][280 + v] += 1
        else:
            c[0][256 + v - 1] += 1
            c[4][1] += 1  # distance code 2 is the pixel to the left
    lengths = [[webp.code_lengths(c if any(c) else [1, *c[1:]]) for c in g] for g in counts]
    for g in lengths:
        for n in g:
            webp.put_code(w, n)
    tables = [[webp._canonical(n) for n in g] for g in lengths]
    for i, kind, v in tokens:
        t = tables[of(i)]
        if kind == "pixel":
            for j, s in enumerate((8, 16, 0, 24)):
                w.put(*t[j][(v >> s) & 255])
        elif kind == "cache":
            w.put(*t[0][280 + v])
        else:
            w.put(*t[0][256 + v - 1])
            w.put(*t[4][1])
    return webp.riff(w)


def test_webp_follows_matches_and_tokens_in_strides():
    """One step in Python for four matches and for eight tokens; what is stored reads back."""
    rnd = random.Random(21)
    text = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(rnd.randrange(30)) for _ in range(2000)).encode()
    payload = text + bytes(-len(text) % 64)
    calls = Counter()

    def watch(frame, event, what):
        if event == "c_call" and what.__name__ == "append" and frame.f_code.co_name in ("_matches", "_one_channel"):
            calls[frame.f_code.co_name] += 1

    sys.setprofile(watch)
    try:
        starts, lengths, back = webp._matches(np.frombuffer(payload, np.uint8))
        matched = calls["_matches"]
        media = webp.store(payload)
        read = webp.samples_of(webp.pixel_arrays(media)).tobytes()
    finally:
        sys.setprofile(None)
    assert read == payload
    assert len(starts) > 500 and (starts[1:] >= (starts + lengths)[:-1]).all()
    assert all(payload[a : a + n] == payload[a - b : a - b + n] for a, b, n in zip(starts, back, lengths))
    assert matched <= len(starts) / 4 + 1
    tokens = len(starts) + len(payload) - int(lengths.sum())
    assert calls["_one_channel"] <= tokens / 8 + 10


def test_webp_decodes_every_feature():
    rnd = np.random.default_rng(5)
    pixels = rnd.integers(0, 1 << 32, (23, 19), dtype=np.uint32)
    pixels[5:12] = 0xFF336699
    pixels[14:, 3:9] = rnd.choice(np.array([0xFF000000, 0x80FF00FF, 0x01020304], np.uint32), (9, 6))
    found, size = webp.decode(data := encode_fully(pixels))
    assert (found == pixels).all() and size == len(data)
    with pytest.raises(ValueError):
        webp.decode(data[:40] + bytes(0))


@pytest.mark.parametrize("raw", [b"", b"a" * 64, b"ab" * 40, bytes(range(256)) * 3, b"abcde" * 77, bytes(64 * 16385), b"no one knows the way home; " * 60_000, np.random.default_rng(3).bytes(64 * 900), np.random.default_rng(4).bytes(640) * 2])
def test_webp_round_trip(raw):
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    assert webp.samples_of(webp.pixel_arrays(webp.store(payload))).tobytes() == payload


def test_webp_reads_back_references_and_prefix_codes_of_texts(docs, monkeypatch):
    """The fast loop against one symbol at a time, on the stored forms of all texts; both kinds of symbols stand there."""
    payloads = [r.text.encode() for r in docs.filter("length(text) > 300").select("text").collect()]
    payloads = [p + bytes(-len(p) % 64) for p in payloads]
    stored = [webp.store(p) for p in payloads]
    seen = Counter()

    def one_by_one(bits, total, width, green, distance):
        out = []
        while len(out) < total:
            s = green.next(bits)
            seen[s < 256, green.flat > 0] += 1
            if s < 256:
                out.append(s)
                continue
            length, back = webp._prefixed(bits, s - 256), webp._prefixed(bits, distance.next(bits))
            if back <= 120:
                x, y = webp._NEAR[back - 1]
            back = back - 120 if back > 120 else max(1, x + y * width)
            for _ in range(length):
                out.append(out[-back])
        return np.array(out, np.uint8)

    fast = [webp.samples_of(webp.pixel_arrays(m)).tobytes() for m in stored]
    monkeypatch.setattr(webp, "_one_channel", one_by_one)
    assert fast == [webp.samples_of(webp.pixel_arrays(m)).tobytes() for m in stored] == payloads
    assert seen[True, False] > 1000 and seen[False, False] > 1000
    assert sum(map(len, stored)) < 0.6 * sum(map(len, payloads))


@pytest.mark.parametrize("stretch", [1, 7, 4096])
def test_webp_tokens_across_stretches(monkeypatch, stretch):
    """Tokens that begin in one stretch of the stream and end in the next, and copies of copies, are read like any others."""
    monkeypatch.setattr(webp, "STRETCH", stretch)
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, n).tolist()) for n in rng.integers(2, 9, 60)]
    for text in (b" ".join(words[i] for i in rng.integers(0, 60, 900)), b"ab" * 3000, rng.bytes(500) * 4, b"x" * 70000, bytes(range(256)) * 3):
        payload = text + bytes(-len(text) % 64)
        assert webp.samples_of(webp.pixel_arrays(webp.store(payload))).tobytes() == payload


def test_webp_reads_without_a_call_for_each_token():
    """A text is read back with far fewer calls than it has bytes: what a byte costs is not Python's."""
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, n).tolist()) for n in rng.integers(2, 9, 400)]
    payload = b" ".join(words[i] for i in rng.integers(0, 400, 4000))
    payload += bytes(-len(payload) % 64)
    media, calls = webp.store(payload), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    webp.pixel_arrays(media)
    sys.setprofile(count)
    try:
        webp.pixel_arrays(media)
    finally:
        sys.setprofile(None)
    assert len(payload) > 20_000 and calls < len(payload) / 5


def test_webp_of_a_short_text_takes_few_calls():
    """What a short text costs is mostly the codes' descriptions and single calls: 1,872 before, 877 when written."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("etaoinshrdlucm") for _ in range(rnd.randrange(2, 9))) if rnd.random() < 0.5 else rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(500)]
    payload = " ".join(words).encode()
    payload += bytes(-len(payload) % 64)
    webp.pixel_arrays(webp.store(payload))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        read = webp.samples_of(webp.pixel_arrays(webp.store(payload)))
    finally:
        sys.setprofile(None)
    assert read.tobytes() == payload and calls < 1200


@pytest.mark.parametrize("raw", [b"abcabcabd" * 9, b"x" * 9000, b"one line of many; " * 700 + b"and more, " * 500, np.random.default_rng(6).integers(0, 3, 4000).astype(np.uint8).tobytes(), np.random.default_rng(7).bytes(5000) * 2, bytes(range(200))])
def test_webp_matches_are_greedy(raw):
    """Each match is the first that begins at or after the last one's end, to the last place that began with the same pixels,
    as long as the places after it point equally far back; none is beyond the format's longest."""
    last, back = {}, []
    for i in range(len(raw) - webp.MATCH + 1):
        key = raw[i : i + webp.MATCH]
        back.append(i - last[key] if key in last else 0)
        last[key] = i
    starts, lengths, far = (x.tolist() for x in webp._matches(np.frombuffer(raw, np.uint8)))
    at = 0
    for start, n, b in zip(starts, lengths, far, strict=True):
        assert not any(back[at:start]) and back[start] == b > 0 and n <= 4096
        assert set(back[start : start + n - webp.MATCH + 1]) == {b} and raw[start : start + n] == raw[start - b : start - b + n]
        following = start + n - webp.MATCH + 1
        assert n > 3000 or following == len(back) or back[following] != b
        at = start + n
    assert not any(back[at:])


def test_webp_cut_stream_raises():
    media = webp.store((b"a line that comes again and again, " * 30 + np.random.default_rng(1).bytes(100))[:1088])
    for n in range(30, len(media) - 2, 7):
        with pytest.raises(ValueError):
            webp.decode(media[:n])


def test_code_lengths_are_optimal_and_bounded():
    import heapq

    rnd = random.Random(2)
    for n in (1, 2, 3, 17, 90):
        counts = [rnd.choice((0, 1, 2, 9, 400)) for _ in range(n)] + [3]
        heap, cost = [c for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            two = heapq.heappop(heap) + heapq.heappop(heap)
            cost += two
            heapq.heappush(heap, two)
        lengths = webp.code_lengths(counts)
        assert sum(c * k for c, k in zip(counts, lengths)) == (cost or sum(counts)) and all((k > 0) == (c > 0) for c, k in zip(counts, lengths))
    steep = webp.code_lengths([2**k for k in range(30)], 11)
    assert max(steep) <= 11 and sum(2.0 ** -k for k in steep) == 1


def test_media_column(edges, nothing):
    import zlib

    for r in webp.media_column(edges, pixels=True).join(edges.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, bytes(r.samples)) == (len(raw), len(payload), payload)
        assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(bytes(r.media)).hexdigest())
    assert webp.media_column(nothing).count() == 0


def test_warc(spark):
    rows = [(1, "http://a.b.org:80/x?q=1#f", "same"), (2, None, "same"), (3, "https://a.b.org", ""), (4, "x\ty", None), (4, "x\ty", None), (5, "http://a.b.org/x?q=1", "z" * 10**5), (6, "http://a.b.org/x?q=1", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.new_folder(spark)
    captures = warc.write(pages, folder)
    directory = warc.build_index(captures, folder, block_lines=2)
    found = sorted(tuple(r)[1:] for r in warc.look_up(captures, directory, folder).collect())
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    want = [(i, len(h or ""), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    one = warc.look_up(spark.createDataFrame([("org,b,a)/x?q=1",), ("none)/",)], "url_key string"), directory, folder)
    assert sorted(r.page_id for r in one.collect()) == [1, 5, 6]
    limit, warc.MAX_DIRECTORY = warc.MAX_DIRECTORY, 0
    try:
        assert sorted((tuple(r)[1:] for r in warc.look_up(captures, directory, folder).collect()), key=str) == sorted(want, key=str)
        assert "NestedLoop" not in warc.look_up(captures, directory, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        warc.MAX_DIRECTORY = limit
    empty = warc.write(pages.limit(0), folder)
    assert warc.look_up(empty, warc.build_index(empty, folder), folder).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == names
    assert docs.count() > 0
    edge = spark.createDataFrame([r[:5] for r in EDGES], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (edge, edge.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        rows.count()
