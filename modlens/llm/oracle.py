"""DuckDB SQL of the queries that SQL can express, on the pre-registered table views."""

from __future__ import annotations

_WORDS = r"""
  select doc_id, text,
         case when text is null then [] else regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') end as w
  from documents
"""

OP2 = f"""
with recursive words as ({_WORDS}),
sets as (
  select doc_id, case when len(w) = 0 then []
    when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s
  from words),
posts as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
  select a.doc_id as u, b.doc_id as v from posts a join posts b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(src, node) as (
  select distinct u, u from links
  union
  select r.src, l.v from reach r join links l on r.node = l.u),
comp as (select src, min(node) as component_id from reach group by src)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(c.component_id, s.doc_id) as component_id
from sets s left join comp c on c.src = s.doc_id
"""

OP7 = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where embedding is not null and label is not null and vec_id is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links as (
  select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(src, node) as (
  select distinct u, u from links
  union
  select r.src, l.v from reach r join links l on r.node = l.u),
comp as (select src, min(node) as c from reach group by src),
n as (select u, count(*) as n from links group by u)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(comp.c, vec_id) as component_id,
       vec_id = coalesce(comp.c, vec_id) as kept
from embeddings left join n on n.u = vec_id left join comp on comp.src = vec_id
"""

OP9 = r"""
with sized as (
  select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint as k
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
  from sized group by source),
c as (
  select *, 2 * source_size as cap, 1.5::double * (sum(source_size) over ())::double as total,
         (sum(2 * source_size) over o - 2 * source_size)::double as before,
         sum(w) over (order by (2 * source_size)::double / w, source nulls last rows between current row and unbounded following) as rest
  from s window o as (order by (2 * source_size)::double / w, source nulls last rows between unbounded preceding and current row)),
l as (select *, max((total - before) / rest::double) over () as level from c),
t as (
  select source, source_size, least(cap::double, level * w) as target,
         case when source_size > 0 then floor(least(cap::double, level * w) / source_size) else 0 end::bigint as copies from l),
p as (
  select *, target - copies * source_size as need,
         case when source_size > 0 then (target - copies * source_size) / source_size else 0.0 end as f from t),
r as (
  select d.doc_id, d.source, d.size, d.k, p.source_size, p.target, p.copies, p.need, p.f,
         case when p.f > 0 then ((d.k + 0.5::double) / 4503599627370496.0::double) / (1 - (d.k + 0.5::double) / 4503599627370496.0::double)
           * ((1 - p.f) / p.f) end as pareto_rank
  from sized d join p on d.source is not distinct from p.source),
o as (
  select *, sum(size) over (partition by source order by pareto_rank, k, doc_id, size rows between unbounded preceding and current row)
    - size as before from r)
select doc_id, source, size, source_size, target, copies, pareto_rank,
       size * (copies + case when f > 0 and 2 * before + size <= 2 * need then 1 else 0 end)::bigint as taken
from o
"""

OP11 = """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and vec_id is not null
    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.e, b.e) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP12 = r"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (
  select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
         ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
         ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (
  select *, len(units)::bigint as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
              when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (
  select *, array_to_string(units[1:a], '') as pre, array_to_string(units[a + 1:b], '') as mid,
         array_to_string(units[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars,
       case when form <> 'plain' then length(mid) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
                        else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""

ORACLE = {"op2_ngram_jaccard": OP2, "op7_embeddings": OP7, "op9_mixing": OP9, "op11_neighbours": OP11,
          "op12_infill": OP12}
