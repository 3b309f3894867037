"""SQL twins of the corpus queries that SQL can express.

Language mixtures, byte-pair merges, context trees, wrappers, images and packing have none; near-duplicate components
and span removal need recursion or hashing over all documents, fingerprints a hash that SQL lacks; they are tested against
brute force instead.
"""
from __future__ import annotations

from . import centroids, quality, trie

_SENTENCE = r"\S{1,200}\s+" * 9 + r"\S"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fails(line: str) -> str:
    phrases = " or ".join(f"contains({line}, {_quoted(p)})" for p in quality.BOILERPLATE)
    last = f"right(rtrim({line}), 1)"
    return (
        f"(regexp_matches({line}, {_quoted(quality.DECORATED)}) or regexp_matches({line}, {_quoted(quality.MENU)}) or {phrases} "
        f"or (not ({last} <> '' and instr({_quoted(quality.CLOSING)}, {last}) > 0) and not regexp_matches({line}, {_quoted(_SENTENCE)})))")


_WORD = r"[^\x20\x09-\x0D]+"
QUALITY = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as (select doc_id, t, regexp_extract_all(t, '{_WORD}') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as solid from d),
g as (select doc_id, unnest(generate_series(1, len(words) - 2)) as i, words from m where len(words) >= 3),
r as (select doc_id, i, count(*) over (partition by doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) as times from g),
p as (select doc_id, count(distinct place) as n from (select doc_id, unnest([i, i + 1, i + 2]) as place from r where times > 1) group by doc_id),
f as (select m.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(solid) - len(list_distinct(solid)) as bigint) as n_dup_lines, cast(coalesce(p.n, 0) as bigint) as n_repeat_words,
  cast(coalesce(list_sum(list_transform(solid, lambda x: length(x))), 0) as bigint) as line_chars,
  cast(coalesce(list_sum(list_transform(list_filter(solid, lambda x: not {_fails('lower(x)')}), lambda x: length(x))), 0) as bigint) as kept_chars
  from m left join p on m.doc_id = p.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * kept_chars >= {quality.MIN_KEPT_PERCENT} * line_chars as kept, kept_chars, line_chars from f"""

_BITS = "array_to_string(list_transform(string_split(sha1(t), ''), lambda c: right('0000' || bin(instr('0123456789abcdef', c) - 1), 4)), '')"
WARC = f"""
with p as (select page_id, coalesce(html, '') as t from pages),
b as (select page_id, t, {_BITS} as bits, min(page_id) over (partition by t) as first from p)
select page_id, cast(octet_length(encode(t)) as bigint) as payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(generate_series(0, 4), lambda j: case when substring(bits, 5 * i + j + 1, 1) = '1' then 1 << (4 - j) else 0 end)) as bigint), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from b"""

_ORDER = "order by turn nulls first, r, digest"
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast({0} as varchar), ''), lambda x: cast(ascii(x) as bigint))), lambda c, x: "
    "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))")
TRIE = f"""
with t as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t, md5(cast(octet_length(encode(coalesce(role, ''))) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as digest
  from conversations where conv_id is not null),
own as (select conv_id, list(digest {_ORDER}) as ds, list(octet_length(encode(t)) {_ORDER}) as bs, {_CRC.format('conv_id')} % {trie.HEADS} as h from t group by conv_id),
c as (select a.conv_id, coalesce(b.ds[1:a.h], []) || a.ds[a.h + 1:] as ds, coalesce(b.bs[1:a.h], []) || a.bs[a.h + 1:] as bs from own a left join own b on b.conv_id = a.conv_id - a.conv_id % {trie.GROUP}),
m as (select conv_id, array_to_string(ds[1:d], '') as id, d as depth, case when d = 0 then 0 else bs[d] end as bytes, len(ds) = d as ends from (select *, unnest(generate_series(0, len(ds))) as d from c)),
n as (select id, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(bytes) as saved, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '') as members from m group by id),
k as (select id[1:length(id) - 32] as parent, count(*) as kids from n where depth > 0 group by 1),
s as (select id[1:32 * up] as id, sum(saved) as saved, count(*) filter (leaf) as leaves from
  (select n.id, n.saved, k.kids is null as leaf, unnest(generate_series(0, n.depth)) as up from n left join k on k.parent = n.id) group by 1)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.kids, 0) as n_children, s.leaves as n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(n.members) as ends_sha256
from n join s on s.id = n.id left join k on k.parent = n.id left join n p on n.depth > 0 and p.id = n.id[1:length(n.id) - 32]"""


def _clusters() -> str:
    """Every round is a table of its own: the nearest centroid of each vector, then the floors of the means."""
    near = (
        "select key, v, s.number, s.distance from (select key, any_value(v) as v, min(struct_pack(distance := distance, number := number)) as s from "
        "(select a.key, a.v, c.number, list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from vectors a, {0} c) group by key)")
    floors = ", ".join(f"cast((sum(v[{i}]) - ((sum(v[{i}]) % count(*)) + count(*)) % count(*)) // count(*) as bigint)" for i in range(1, centroids.DIMS + 1))
    out = [
        f"vectors as materialized (select vec_id as key, list_transform(embedding, lambda x: cast(floor({centroids.SCALE} * cast(x as double)) as bigint)) as v from embeddings "
        f"where len(embedding) = {centroids.DIMS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select row_number() over (order by sha256('{centroids.SALT}:' || cast(key as varchar))) - 1 as number, v from vectors qualify number < {centroids.CENTROIDS})"]
    for i in range(centroids.ROUNDS):
        out.append(f"a{i} as materialized ({near.format(f'c{i}')})")
        out.append(f"c{i + 1} as materialized (select c.number, coalesce(m.v, c.v) as v from c{i} c left join (select number, [{floors}] as v from a{i} group by number) m on m.number = c.number)")
    last = f"c{centroids.ROUNDS}"
    return (
        f"with {', '.join(out)}, f as materialized ({near.format(last)}) select f.key as vec_id, cast(f.number as int) as cluster, f.distance, cast(sum(f.distance) over (partition by f.number) as bigint) as cluster_inertia, "
        f"cast(sum(f.distance) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256 from f join {last} c on c.number = f.number")


ORACLES = {"op1_quality_rules": QUALITY, "op10_warc_index": WARC, "op12_patricia_trie": TRIE, "op13_partial_distance_clusters": _clusters()}
