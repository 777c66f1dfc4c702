"""DuckDB SQL for the training-data queries that SQL can express, over the whole tables."""

from __future__ import annotations

#: The digits of base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Five hexadecimal digits of the SHA-1 hold four base32 digits.
OP2_WARC = f"""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha1(body) as h, max(page_id) over (partition by body) as answer from p)
select page_id, payload_bytes,
  array_to_string([substr('{_BASE32}', cast((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint) + 1, 1) for i in range(32)], '') as payload_digest,
  case when page_id = answer then 'response' else 'revisit' end as record_type,
  case when page_id <> answer then answer end as refers_to
from d
"""

#: ``reach`` follows links to every document; its smallest is the component.
_REACH = """
edges as (select a, b from links union select b, a from links),
reach(id, seen) as (select a, b from edges union select r.id, e.b from reach r join edges e on r.seen = e.a),
lowest as (select id, min(seen) as low from reach group by id)
"""

OP5_MINHASH = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
  else list_distinct([array_to_string(words[i : i + 3], ' ') for i in range(1, len(words) - 2)]) end as items from w),
x as (select doc_id, unnest(items) as item from s),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as inter from x a join x b on a.item = b.item and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join s p on p.doc_id = a join s q on q.doc_id = b where 100 * inter >= 80 * (len(p.items) + len(q.items) - inter)),
{_REACH}
select doc_id, len(items) as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id, doc_id <= coalesce(low, doc_id) as kept
from s left join lowest on id = doc_id
"""

OP9_EMBEDDING_DEDUP = f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
good as (select *, sqrt(list_dot_product(v, v)) as norm from v
  where label is not null and len(v) > 0 and len(list_filter(v, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(v, lambda c: c <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id < b.vec_id
  where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
{_REACH},
degree as (select a as id, count(*) as n from edges group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, vec_id <= coalesce(low, vec_id) as kept
from v left join lowest on lowest.id = vec_id left join degree on degree.id = vec_id
"""

#: ``crc`` holds one list, ``t``: what a byte does to an unsigned crc32 (fixed value: its polynomial, reversed).
_CRC = """
crc as materialized (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as v from (select unnest(range(256)) as i)))
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a text column beside ``crc``."""
    bytes_ = f"[cast('0x' || substr(hex({text}), cast(2 * i + 1 as bigint), 2) as bigint) for i in range(strlen({text}))]"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, t[cast((xor(c, b) & 255) + 1 as bigint)])), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_RESAMPLING = rf"""
with {_CRC},
d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
x as materialized (select doc_id, unnest(words) as word from d),
y as materialized (select unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
buckets as materialized (select word, {_crc32('word')} % 10000 as bucket from (select word from x union select word from y), crc),
s as (select bucket, count(*) as n from x join buckets using (word) group by 1),
t as (select bucket, count(*) as n from y join buckets using (word) group by 1),
gains as materialized (select bucket, cast(floor(1000 * ln(cast((coalesce(t.n, 0) + 1) * ((select count(*) from x) + 10000) as double) / cast((coalesce(s.n, 0) + 1) * ((select count(*) from y) + 10000) as double))) as bigint) as gain
  from (select unnest(range(10000)) as bucket) left join s using (bucket) left join t using (bucket)),
sums as (select doc_id, sum(gain) as total from x join buckets using (word) join gains using (bucket) group by 1),
weights as (select doc_id, len(words) as n_features, cast(case when len(words) = 0 then 0 else (total - ((total % len(words)) + len(words)) % len(words)) // len(words) end as bigint) as weight from d left join sums using (doc_id)),
scores as (select *, weight + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5) / 4294967296.0::double))) as bigint) as score from weights),
ranks as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scores where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank from scores left join ranks using (doc_id)
"""

OP12_SUBSTRINGS = r"""
with w as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
x as materialized (select doc_id, i, array_to_string(words[i : i + 19], ' ') as passage from (select doc_id, words, unnest(range(1, len(words) - 18)) as i from w)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by passage order by doc_id, i) as place from x) where place > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from later),
kept as (select doc_id, string_agg(word, ' ' order by i) as kept, count(*) as n from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from w) anti join gone using (doc_id, i) group by 1)
select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (doc_id)
"""

OP13_SPELLING = rf"""
with recursive {_CRC},
x as (select doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
y as materialized (select doc_id, run, count(*) as n, doc_id || ':' || run as t_ from x group by 1, 2),
h as (select *, {_crc32('t_')} as h from y, crc),
words as (select case when h % 199 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) + 2 as bigint)) else run end as word, n from h),
v as materialized (select word, cast(sum(n) as bigint) as n from words group by 1 having length(word) >= 6 and sum(n) >= 5),
d as materialized (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as less from (select word, unnest(range(1, length(word) + 1)) as i from v)),
near as materialized (select a.word, b.word as other from d a join d b on a.i = b.i and a.less = b.less and a.word <> b.word
  union select d.word, v.word from d join v on d.less = v.word union select v.word, d.word from d join v on d.less = v.word),
best as (select near.word, count(*) as n_near, arg_min(other, (-v.n, other)) as best, max(v.n) as best_n from near join v on v.word = other group by 1),
f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * v.n then best end as form, case when best_n >= 5 * v.n then best_n end as form_n from v left join best using (word)),
walk(word, root, k) as (select word, word, 0 from f union all select walk.word, f.form, k + 1 from walk join f on f.word = walk.root where f.form is not null)
select f.word, form, root, n, n_near, form_n from f join (select word, arg_max(root, k) as root from walk group by 1) using (word)
"""

ORACLE_SQL = {"op2_warc": OP2_WARC, "op5_minhash": OP5_MINHASH, "op9_embedding_dedup": OP9_EMBEDDING_DEDUP, "op11_resampling": OP11_RESAMPLING, "op12_substrings": OP12_SUBSTRINGS, "op13_spelling": OP13_SPELLING}
