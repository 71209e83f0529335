"""DuckDB statements of the operators that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_mixing"] = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents),
per as (
  select source, cast(sum(size) as bigint) as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w
  from sized group by source),
ordered as (
  select *, row_number() over (order by source_size * 1.0 / w, source nulls last) as k from per),
running as (
  select *, (select sum(source_size) from per)
            - coalesce(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as rest,
         (select sum(w) from per)
            - coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0) as weight
  from ordered),
level as (
  select cast(rest as bigint) as rest, cast(weight as bigint) as weight from running
  where not 3 * source_size * weight < w * rest order by k limit 1),
rates as (
  select source, source_size,
         case when 3 * source_size * r.weight < w * r.rest then cast(3 * source_size as double)
              else cast(w * level.rest as double) / cast(level.weight as double) end as target
  from running r, level),
rated as (
  select doc_id, size, source_size, target,
         case when source_size > 0 then target / source_size else 0.0 end as rate
  from sized join rates on sized.source is not distinct from rates.source)
select doc_id, size, source_size, target,
       cast(floor(rate) + case when
         cast(concat('0x', substr(md5(concat('mix:', coalesce(cast(doc_id as varchar), ''))), 1, 8)) as bigint) / 4294967296.0
         < rate - floor(rate) then 1 else 0 end as bigint) * size as taken
from rated
"""

ORACLES["op8_exact_dedup"] = """
with g as (select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size
           from documents group by 1)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(coalesce(text, '')) as text_sha256
from documents join g on coalesce(text, '') = t
"""

ORACLES["op9_url_filter"] = r"""
with rest as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
split as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hits as (
  select page_id, host, path, h, p, verdict,
         row_number() over (partition by page_id, host, path order by length(h || p) desc, length(h) desc) as k
  from split left join rules on (host = h or suffix(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, h || p as rule, coalesce(verdict, 'allow') as verdict from hits where k = 1
"""

ORACLES["op5_repeats"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from d),
k as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as key
      from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d)),
smallest as (select key, min(doc_id) as m from k group by key),
bad as (select doc_id, i, 1 as hit from k join smallest using (key) where m < doc_id),
c as (select doc_id, i, word, max(coalesce(hit, 0)) over (partition by doc_id order by i
        rows between 49 preceding and current row) as gone from w left join bad using (doc_id, i)),
s as (select doc_id, sum(gone) as gone, string_agg(word, ' ' order by i) filter (where gone = 0) as kept
      from c group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(gone, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join s using (doc_id)
"""

# line keys are told apart by their text, not by hashes
ORACLES["op12_line_dedup"] = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
shared as (select key, min(doc_id) as first from k where length(key) >= 10
           group by key having count(distinct doc_id) >= 2),
j as (select doc_id, i, line, coalesce(doc_id > first, false) as gone from k left join shared using (key))
select doc_id, count(*) as n_lines, cast(count_if(gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""


def _kmeans(rounds: int = 5, k: int = 40) -> str:
    """One pair of expressions per round: the assignment by the last centroids, then their means."""
    steps = ["""
kept as (select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
         where len(embedding) = 64 and len([x for x in embedding if isfinite(x)]) = 64)""", f"""
c0 as (select cast(row_number() over (order by sha256('2:' || vec_id), v) - 1 as int) as c, v as m from kept
       qualify c < {k})"""]
    assign = """
a{t} as (select vec_id, v, arg_min(c, (dist, c)) as c, min(dist) as dist from (
           select vec_id, v, c, cast(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as dist
           from kept, c{t}) group by vec_id, v)"""
    move = """
c{u} as (select c{t}.c, coalesce(s.m, c{t}.m) as m from c{t} left join (
           select c, list(cast(((s - ((s % n) + n) % n)) // n as bigint) order by d) as m from (
             select c, d, cast(sum(x) as bigint) as s, count(*) as n from (
               select c, unnest(v) as x, unnest(range(1, 65)) as d from a{t}) group by c, d) group by c) s using (c))"""
    for t in range(rounds):
        steps += [assign.format(t=t), move.format(t=t, u=t + 1)]
    steps.append(assign.format(t=rounds))
    return "with " + ",".join(f"{s.strip().split(' as ', 1)[0]} as materialized {s.strip().split(' as ', 1)[1]}" for s in steps) + f"""
select vec_id, c as cluster, dist as distance,
       cast(sum(dist) over (partition by c) as bigint) as cluster_inertia, cast(sum(dist) over () as bigint) as inertia,
       sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (c)"""


ORACLES["op11_clustering"] = _kmeans()

# crc32 byte by byte over its table of 256 remainders; neighbours by patterns with one gap
ORACLES["op13_spelling"] = r"""
with recursive bits as (
  select i, cast(i as ubigint) as r, 0 as k from range(256) t(i)
  union all
  select i, case when r & 1 = 1 then xor(r >> 1, cast(3988292384 as ubigint)) else r >> 1 end, k + 1 from bits where k < 8),
crc as (select list(r order by i) as t from bits where k = 8),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
used as (select doc_id, run, count(*) as m, coalesce(cast(doc_id as varchar), '') || ':' || run as s from runs group by doc_id, run),
hashed as (
  select run, m, xor(list_reduce(list_prepend(cast(4294967295 as ubigint), flatten(list_transform(string_split(s, ''),
           lambda c: case when unicode(c) < 128 then [cast(unicode(c) as ubigint)]
                     else [cast(192 + (unicode(c) >> 6) as ubigint), cast(128 + (unicode(c) & 63) as ubigint)] end))),
           lambda a, b: xor(a >> 8, t[cast(xor(a, b) & 255 as bigint) + 1])), cast(4294967295 as ubigint)) as h
  from used, crc),
words as (
  select word, cast(sum(m) as bigint) as n from (
    select m, case when h % 97 = 0 then run[1:cast(h % length(run) as bigint)] || run[cast(h % length(run) as bigint) + 2:]
              else run end as word from hashed)
  where length(word) >= 5 group by word having sum(m) >= 3),
gaps as (select word, n, unnest([word[1:i - 1] || '*' || word[i + 1:] for i in range(1, length(word) + 1)]) as gap from words),
cuts as (select distinct word, n, replace(gap, '*', '') as cut from gaps),
pairs as (
  select a.word, b.word as other, b.n as m from gaps a join gaps b using (gap) where a.word <> b.word
  union select c.word, w.word, w.n from cuts c join words w on c.cut = w.word
  union select w.word, c.word, c.n from cuts c join words w on c.cut = w.word),
near as (select word, count(*) as n_near, max(m) as top from pairs group by word),
best as (select word, min(other) as other from pairs join near using (word) where m = top group by word),
named as (select w.word, n, coalesce(n_near, 0) as n_near,
                 case when top >= 2 * n then other end as form, case when top >= 2 * n then top end as form_n
          from words w left join near using (word) left join best using (word)),
chain as (select word, word as root, form as next from named
          union all select c.word, m.word, m.form from chain c join named m on c.next = m.word),
roots as (select word, root from chain where next is null)
select word, form, root, n, n_near, form_n from named join roots using (word)
"""
