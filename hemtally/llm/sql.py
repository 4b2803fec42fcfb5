"""The same answers in SQL, for those operators that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
p as (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from d),
g as (select r, doc_id, i, array_to_string(w[i : i + 12], ' ') as g from p),
f as (select g, min(doc_id) as least from g group by g),
gone as (select distinct r, unnest(range(i, i + 13)) as i from g join f using (g) where doc_id > least),
c as (select r, list(i) as i from gone group by r)
select doc_id, len(w) as n_words, coalesce(len(c.i), 0) as n_removed,
  sha256(array_to_string(list_filter(w, lambda x, k: not coalesce(list_contains(c.i, k), false)), ' ')) as kept_sha256
from d left join c using (r)
"""

FILTER_AUDIT = rf"""
with t as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part, {_WORDS} as w from documents),
first as (select t, min(doc_id) as least from t group by t),
l as (select doc_id, coalesce(max(quality) = 1, false) as good, coalesce(max(toxic) = 1, false) as toxic from labels group by doc_id),
m as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    (case when len(w) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end)
    || (case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) then 'C' else '' end)
    || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when doc_id > least then 'E' else '' end) as mask
  from t join first using (t) left join l using (doc_id)),
n as (select part, mask, good, toxic, count(*) as n from m group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, filter_order[step] as own, left(filter_order, step - 1) as before from o, (select unnest(range(1, 6)) as step)),
j as (
  select s.*, n.*, contains(mask, own) as fails, length(translate(before, mask, '')) < step - 1 as lost from s, n),
r as (
  select part, filter_order, step, own, sum(case when not fails and not lost then n else 0 end) as kept, sum(case when fails and not lost then n else 0 end) as removed,
    sum(case when fails and lost then n else 0 end) as redundant, sum(case when mask = own then n else 0 end) as unique_fails,
    sum(case when fails and not lost and good then n else 0 end) as good_lost, sum(case when fails and not lost and toxic then n else 0 end) as toxic_lost
  from j group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) as shapley
from r
"""


def vector_codes(rounds: int = 6) -> str:
    """Every round is an assignment and an update of all entries."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} as materialized (
  select r, part, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := entry)) as b
  from sub join book{k} using (part) group by r, part)""")
        if k < rounds:
            steps.append(f"""
sums{k} as (
  select part, entry, i, cast((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as c
  from (select s.part, b.e as entry, unnest(x) as v, unnest(range(len(x))) as i from sub s join near{k} n on s.r = n.r and s.part = n.part) group by all),
book{k + 1} as materialized (
  select part, entry, coalesce(u.c, o.c) as c
  from book{k} o left join (select part, entry, list(c order by i) as c from sums{k} group by all) u using (part, entry))""")
    return f"""
with kept as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
sub as materialized (select r, vec_id, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] as x from kept, (select unnest(range(8)) as part)),
book0 as (select part, dense_rank() over (order by vec_id) - 1 as entry, x as c from sub where vec_id in (select vec_id from kept order by vec_id limit 16)),
{",".join(steps)},
books as (
  select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds}),
done as (
  select r, string_agg(printf('%02x', cast(b.e as int)), '' order by part) as code, cast(sum(b.d) as bigint) as error from near{rounds} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept join done using (r), books
"""
