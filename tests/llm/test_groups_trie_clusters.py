"""Fingerprint groups, the conversation trie and centroid clusters against brute force and SQL."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from sievework.llm import centroids, oracles, queries, simhash, trie

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(nodes, linked):
    """nodes: name -> smallest id; the smallest id reachable from each."""
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = list(nodes)
    for k, a in enumerate(names):
        for b in names[:k]:
            if linked(a, b):
                parent[top(a)] = top(b)
    least = {}
    for n in names:
        least[top(n)] = min(least.get(top(n), nodes[n]), nodes[n])
    return {n: least[top(n)] for n in names}


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_groups_equal_brute_force(spark, docs, crowd):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    near = []
    for i in range(60):  # copies that drift apart: chains of links, and places of many residents
        base[rng.randrange(120)] = f"v{i}"
        near.append((10_000 + i, " ".join(base)))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in both.collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    expected = plain_groups({i: i for i in prints}, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.doc_id: r for r in simhash.near_duplicates(both, crowd=crowd).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == expected
    assert len(set(expected.values())) < len(expected) - 20


def test_every_near_pair_meets(spark):
    """All pairs of up to four differing bits, and a few of five, from random and from crowded prints."""
    rng = random.Random(7)
    pairs = []
    for bits in (1, 2, 3, 4, 5):
        for _ in range(150):
            a = rng.getrandbits(64)
            pairs.append((bits, a, a ^ sum(1 << b for b in rng.sample(range(64), bits))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p), i, 1) for i, p in enumerate(p for _, a, b in pairs for p in (a, b))]
    classes = spark.createDataFrame(rows, "print long, rep long, n long")
    met = simhash._dealt(classes, None).repartition(5, "place", "i", "j").sortWithinPartitions("place", "i", "j", "role", "print").mapInArrow(simhash._met, "a long, b long")
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in met.collect()}
    assert found == {(2 * i, 2 * i + 1) for i, (bits, _, _) in enumerate(pairs) if bits <= 4}


def test_fingerprint_of_long_and_odd_texts(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["Alpha", "beé", "中文", "x" * 90, "\U0001f600"]) for _ in range(900)) + "\x0b\x0c"
    expected = plain_print(text)
    for piece in (1 << 20, 64, 7):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text) % (1 << 64) == expected
    assert simhash.fingerprint("One two") % (1 << 64) == plain_print("one two") and simhash.fingerprint(" \t") == simhash.fingerprint(None) == 0


def test_group_edges(spark):
    rows = [(1, None, "p"), (2, "", "p"), (3, " \n", None), (4, "a b c d e", "p"), (4, "a b c d e", "p"), (4, "quite another text of nine words is here", "p"), (9, "quite another text of nine words is here", "p"), (None, "a b c d e", "p"), (None, None, None), (7, "z" * 300_000, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, print string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by == {1: {1}, 2: {1}, 3: {1}, 4: {4}, 9: {4}, None: {None}, 7: {7}}
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    with pytest.raises(TypeError):
        simhash.near_duplicates(df.selectExpr("cast(doc_id as string) as doc_id", "text"))


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v, key=lambda x: x[:4])] for c, v in turns.items()}
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path)))
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    ends = {n: ",".join(map(str, sorted(c for c, size in m if size == len(n)))) for n, m in members.items()}
    return ordered(
        (min(m)[0], len(n), min(members[n[:-1]])[0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items())


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is not None, v) for v in r])


def trie_of(df, **options):
    return ordered(tuple(r) for r in trie.prefix_trie(df, **options).collect())


TURNS = "conv_id long, turn long, role string, text string, path string, part int"


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force_over_many_ranges(spark, seed):
    """Ranges as small as a few paths: shared first turns, long shared chains, equal conversations and prefixes of others."""
    rng = random.Random(seed)
    rows = []
    for c in range(120):
        if rng.random() < 0.3:  # a third are equal
            said = ["hot", "x", "y"]
        else:
            said = (["hot"] * rng.choice([0, 1, 6, 9]) if rng.random() < 0.7 else []) + [rng.choice(["a", "bb", "é", None, ""]) for _ in range(rng.choice([1, 2, 10]))]
        rows += [(c, t if rng.random() > 0.03 else None, rng.choice(["user", None]) if t > 8 else "user", s, "p", 1) for t, s in enumerate(said)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert trie_of(spark.createDataFrame(rows, TURNS), piece=60) == plain_trie([r[:4] for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_trie_edges(spark):
    rows = [(None, 1, "user", "lost", None, 1), (5, None, None, None, "p", None), (6, 2, "a", "x" * 200_000, "p", 1), (6, 2, "a", "x" * 200_000, "p", 1), (-3, 0, "", "", "p", 1), (6, None, "z", "", "p", 1)]
    df = spark.createDataFrame(rows, TURNS)
    assert trie_of(df) == plain_trie([(c, *r) if c != -3 else (c, *r) for c, *r in [x[:4] for x in rows]])
    assert trie_of(df.limit(0)) == []
    alone = spark.createDataFrame([(1, 0, "user", "base is absent", "p", 1)], TURNS)  # crc32("1") % 9 > 0: no turn is left
    assert trie_of(alone) == plain_trie([(1, 0, "user", "base is absent")]) and len(trie_of(alone)) == 1


def plain_clusters(vectors, k=40, rounds=5):
    """vectors: (vec_id, integers)."""
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)[:k]
    c = [list(v) for _, v in seeds]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in vectors:
            groups[near(v)[1]].append(v)
        for n, g in groups.items():
            c[n] = [sum(x) // len(g) for x in zip(*g)]
    found = [(i, *near(v)) for i, v in vectors]
    per = defaultdict(int)
    for _, d, n in found:
        per[n] += d
    return ordered((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in found)


VECTORS = "vec_id long, embedding array<float>, label int, v string, key string"


def test_clusters_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.5, 1 / 256, -1 / 512]) for _ in range(64)], 1, "v", "k") for i in range(120)] + [(200 + i, [0.25] * 64, None, "v", None) for i in range(60)] + [(200, [0.25] * 64, 1, "v", "k")]
    bad = [(300, None, 1, "v", "k"), (301, [0.5] * 63, 1, "v", "k"), (302, [float("nan")] * 64, 1, "v", "k"), (303, [None] + [0.5] * 63, 1, "v", "k"), (304, [float("inf")] * 64, 1, "v", "k"), (305, [1e30] * 64, 1, "v", "k")]
    none = [(None, [0.75] * 64, 1, "v", "k")]
    df = spark.createDataFrame(rows + bad + none, VECTORS)
    whole = [(r[0], [int(np.floor(256 * np.float64(np.float32(x)))) for x in r[1]]) for r in rows + none]
    got = ordered(tuple(r) for r in centroids.cluster(df).collect())
    assert got == plain_clusters(whole)
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert ordered(tuple(r) for r in centroids.cluster(few).collect()) == plain_clusters(whole[:3])
    assert centroids.cluster(df.limit(0)).collect() == [] == centroids.cluster(spark.createDataFrame(bad, VECTORS)).collect()
    with pytest.raises(TypeError):
        centroids.cluster(df.selectExpr("'x' as vec_id", "embedding"))


def test_partial_distances_keep_ties_and_abandon():
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 3, (300, 64))
    v[:, 10:20] *= 100  # most of the distance lies in a few dimensions
    c = np.concatenate([v[:20], v[:20], v[5:6]])
    order = np.argsort(-v.var(0), kind="stable")
    found, best, work = centroids.nearest(v, c, order)
    full = ((v[:, None] - c[None]) ** 2).sum(2)
    assert (found == full.argmin(1)).all() and (best == full.min(1)).all()
    assert work < 0.6 * 300 * len(c) * 64


@pytest.mark.parametrize("name", ["op12_patricia_trie", "op13_partial_distance_clusters"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = queries.queries()[name](spark, SF)
    names = sorted(found.columns)
    rows = con.sql(f"select {', '.join(names)} from ({oracles.ORACLES[name]})").fetchall()
    assert ordered(tuple(r) for r in found.select(*names).collect()) == ordered(rows)
