"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"

MIXING = rf"""
with sized as (select doc_id, text, source, {_WORDS} as size from documents),
named as (select source, sum(size)::DECIMAL(38,0) as s from sized group by source),
weighed as (
  select source, s, 3 * s as bound, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3) + 1] as w,
         sum(s) over () as total
  from named),
ordered as (
  select *, coalesce(sum(bound) over (order by bound / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
         sum(w) over (order by bound / w, source nulls last rows between current row and unbounded following) as onward
  from weighed),
marked as (select *, (total - before)::DOUBLE * w::DOUBLE > bound::DOUBLE * onward::DOUBLE as stopped from ordered),
shared as (
  select *, total - coalesce(sum(case when stopped then bound end) over (), 0) as rest,
         sum(case when not stopped then w end) over () as free
  from marked),
targets as (
  select source, s::BIGINT as source_size,
         least(case when stopped then bound::DOUBLE else rest::DOUBLE * w::DOUBLE / free::DOUBLE end, bound::DOUBLE) as target
  from shared),
rated as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
         ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 as draw
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + case when draw < rate - floor(rate) then 1 else 0 end))::BIGINT as taken
from rated
"""

TOPK = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
queries as (select distinct vec_id, v from vectors where vec_id % 50 = 0),
scored as (
  select q.vec_id as query_id, q.v as query, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as score
  from queries q join vectors c on q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id, query order by score desc, vec_id)::INTEGER as rank from scored)
select query_id, rank, vec_id, try_cast(score as BIGINT) as score from ranked where rank <= 5
"""

ORACLES: dict[str, str] = {"op4_source_mixing": MIXING, "op7_exact_topk": TOPK}
