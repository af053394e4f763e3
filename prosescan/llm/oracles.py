"""DuckDB SQL that queries of this subpackage are compared with."""

from __future__ import annotations

from prosescan.llm import mixing

#: The highest quotients are enumerated and ranked here, where the operator finds them by a divisor.
MIXING_SQL = f"""
with recursive sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents
),
src as (
  select source, cast(sum(size) as bigint) as words, row_number() over (order by source nulls last) - 1 as ix from sized group by source
),
weighed as (select *, [3, 1, 2][(ix % 3 + 1)::int] as weight, 2 * words as cap from src),
-- Sources are full from the smallest cap per weight on; the unit of the first source that isn't full holds for the rest.
filled as (
  select *, coalesce(sum(cap) over (order by cap / weight, ix rows between unbounded preceding and 1 preceding), 0) as before,
         sum(weight) over (order by cap / weight, ix rows between current row and unbounded following) as open_weight,
         (select sum(words) from src) as total
  from weighed
),
level as (select *, (1.5::double * total::double - before::double) / open_weight::double as u, row_number() over (order by cap / weight, ix) as place from filled),
unit as (select arg_min(u, place) filter (where weight * u <= cap) as u from level),
goal as (
  select source, ix, words, total, case when weight * u > cap then cap::double else weight * u end as target from filled, unit
),
block as (select greatest(1, least({mixing.BLOCK_WORDS}, greatest(cast(min(total) as bigint) // {mixing.MANY_BLOCKS}, cast(floor(min(target) filter (where target > 0)) as bigint) // {mixing.BLOCKS_OF_LEAST}))) as b from goal),
shard_count as (
  select *, greatest(1, (words + per - 1) // per) as n_shards
  from (select *, greatest({mixing.SHARD_WORDS}, (cast(total as bigint) + {mixing.MAX_SHARDS - 1}) // {mixing.MAX_SHARDS}) as per from goal)
),
dealt as (
  select d.doc_id, d.size, s.ix, s.words, s.target, md5('mix|' || coalesce(cast(d.doc_id as varchar), '')) as key,
         ('0x' || substr(md5('mix|' || coalesce(cast(d.doc_id as varchar), '')), 1, 8))::bigint % n_shards as shard
  from sized d join shard_count s on d.source is not distinct from s.source
),
cell as (select ix, shard, cast(sum(size) as bigint) as words, (cast(sum(size) as bigint) + b - 1) // b as n_blocks from dealt, block group by ix, shard, b),
source_cap as (select ix, sum(2 * n_blocks) as cap from cell group by ix),
seats as (select least(cast(floor(sum(target) / min(b) + 0.5) as bigint), cast(sum(cap) filter (where target > 0) as bigint)) as q from goal join source_cap using (ix), block),
source_quota as (
  select ix, count(*) as quota
  from (select ix, row_number() over (order by target / (2 * k + 1)::double desc, ix, k) as place
        from (select ix, target, unnest(range(0, cast(cap as bigint))) as k from goal join source_cap using (ix) where target > 0)), seats
  where place <= q group by ix
),
cell_quota as (
  select ix, shard, count(*) as quota
  from (select ix, shard, quota, row_number() over (partition by ix order by words::double / (2 * k + 1)::double desc, shard, k) as place
        from (select c.ix, shard, words, quota, unnest(range(0, 2 * n_blocks)) as k from cell c join source_quota using (ix) where words > 0))
  where place <= quota group by ix, shard
),
planned as (
  select c.ix, c.shard, n_blocks, case when n_blocks = 0 then 0 else coalesce(quota, 0) // n_blocks end as passes,
         case when n_blocks = 0 then 0 else coalesce(quota, 0) % n_blocks end as extra,
         ('0x' || substr(md5('mix|' || c.ix || '|' || c.shard), 1, 8))::bigint as first
  from cell c left join cell_quota q using (ix, shard)
),
laid as (
  select d.*, n_blocks, passes, extra, first, b,
         cast(sum(size) over (partition by ix, shard order by key, doc_id, size rows unbounded preceding) as bigint) as upto
  from dealt d join planned using (ix, shard), block
)
select doc_id, size, words as source_size, target,
       cast(passes * size + case when size = 0 or extra = 0 then 0 else coalesce(list_sum([
         case when (({mixing.STRIDE} % n_blocks) * x + first) % n_blocks < extra then least(upto, (x + 1) * b) - greatest(upto - size, x * b) else 0 end
         for x in range((upto - size) // b, (upto - 1) // b + 1)]), 0) end as bigint) as taken
from laid
"""
