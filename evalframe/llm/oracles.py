"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations


def _round(k: int) -> str:
    return f"""
a{k} as (
  select vec_id, v, min(row(d, c)) as best from (
    select kept.vec_id, kept.row_no, kept.v, cent.c,
           list_sum(list_transform(list_zip(kept.v, cent.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from kept cross join c{k} cent) group by vec_id, row_no, v),
u{k} as (
  select c, list(((total - ((total % n) + n) % n) // n)::bigint order by pos) as v from (
    select best[2] as c, pos, sum(v[pos])::bigint as total, count(*)::bigint as n
    from a{k} cross join range(1, 65) p(pos) group by 1, 2) group by c),
c{k + 1} as (select c{k}.c, coalesce(u{k}.v, c{k}.v) as v from c{k} left join u{k} on u{k}.c = c{k}.c),"""


CLUSTERS = f"""
with kept as materialized (
  select vec_id, row_number() over () as row_no,
         list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
  from embeddings
  where len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
c0 as materialized (
  select row_number() over (order by h) - 1 as c, v
  from (select sha256('1:' || vec_id) as h, v from kept order by h limit 16)),
{''.join(_round(k) for k in range(3))}
last as materialized (
  select vec_id, min(row(d, c)) as best from (
    select kept.vec_id, kept.row_no, cent.c,
           list_sum(list_transform(list_zip(kept.v, cent.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from kept cross join c3 cent) group by vec_id, row_no)
select vec_id, best[2]::int as cluster, best[1]::bigint as distance,
       (sum(best[1]) over (partition by best[2]))::bigint as cluster_inertia,
       (sum(best[1]) over ())::bigint as inertia, sha256(array_to_string(c3.v, ',')) as centroid_sha256
from last join c3 on c3.c = best[2]
"""

_LETTERS = "(values ('A'), ('B'), ('C'), ('D'), ('E'))"
_LEAST = "least(" + ", ".join(f"case when f{x} then instr(filter_order, '{x}') else 9 end" for x in "ABCDE") + ")"
_FAILS = "(" + " or ".join(f"(letter = '{x}' and f{x})" for x in "ABCDE") + ")"
_COUNT = "(fA::int + fB::int + fC::int + fD::int + fE::int)"

FILTER_AUDIT = rf"""
with words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
failed as (
  select doc_id, part, len(w) < 100 as fA, 100 * len(list_distinct(w)) < 80 * len(w) as fB,
         100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) as fC, regexp_matches(t, '[#$%&*|]') as fD,
         doc_id > min(doc_id) over (partition by t) as fE from words),
marks as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
masks as (
  select part, fA, fB, fC, fD, fE, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from failed left join marks using (doc_id) group by all),
orders as (
  select a || b || c || d || e as filter_order
  from {_LETTERS} a(a), {_LETTERS} b(b), {_LETTERS} c(c), {_LETTERS} d(d), {_LETTERS} e(e)
  where len(list_distinct([a, b, c, d, e])) = 5),
stepped as (select masks.*, filter_order, {_LEAST} as gone_at from masks cross join orders),
rows as (
  select stepped.*, s as step, substr(filter_order, s::int, 1) as letter from stepped cross join range(1, 6) r(s)),
counts as (
  select part, filter_order, step::int as step, any_value(letter) as letter,
         (sum(n) filter (gone_at > step)) as kept, (sum(n) filter (gone_at = step)) as removed,
         (sum(n) filter ({_FAILS} and gone_at < step)) as redundant,
         (sum(n) filter ({_FAILS} and {_COUNT} = 1)) as unique_fails,
         (sum(good) filter (gone_at = step)) as good_lost, (sum(toxic) filter (gone_at = step)) as toxic_lost
  from rows group by part, filter_order, step)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
       coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
       coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       (sum(coalesce(removed, 0)) over (partition by part, letter))::bigint as shapley
from counts
"""
