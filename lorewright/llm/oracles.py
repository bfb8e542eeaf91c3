"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

ORACLES = {
    "op1_url_filter": r"""
with parts as (
  select page_id, url, strpos(url, '://') as i, substr(url, strpos(url, '://') + 3) as rest from pages),
split as (
  select page_id, url,
    case when i > 0 then translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when i > 0 then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end as path from parts),
rules(verdict, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits as (
  select url, rhost || rpath as rule, rules.verdict, row_number() over (partition by url order by length(rhost || rpath) desc) as n
  from (select distinct url, host, path from split) s join rules
    on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from split left join (select * from fits where n = 1) f on split.url = f.url""",
    "op4_exact_topk": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 5""",
    "op7_mixing": rf"""
with z as (select doc_id, source, cast({WORDS} as bigint) as size, coalesce(length(text), 0) as chars from documents),
d as (
  select doc_id, source, size,
    1.0 - pow((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) + 0.5) / 4503599627370496.0,
      1.0 / case when size >= 50 and chars between size * 4 and size * 11 then 2.0 when size < 10 then 0.5 else 1.0 end) as k
  from z),
s as (select source, sum(size) as source_size from d group by source),
r as (
  select source, source_size, cast(case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as double) as weight from s),
l as (
  select *, row_number() over o as place,
    (sum(source_size) over () * 1.5 - (sum(2 * source_size) over o - 2 * source_size)) / (sum(weight) over () - (sum(weight) over o - weight)) as level
  from r window o as (order by source_size / weight, source nulls last rows between unbounded preceding and current row)),
t as (
  select source, source_size, least(2.0 * source_size, coalesce((select level from l where level * weight <= 2 * source_size order by place limit 1) * weight, 2.0 * source_size)) as target from l),
b as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
c as (
  select *, cast(round(target - epochs * source_size) as bigint) as due from b),
x as (
  select d.doc_id, d.size, c.source_size, c.target, c.epochs, c.due, sum(d.size) over (partition by d.source order by k, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as before
  from d join c on d.source is not distinct from c.source)
select doc_id, size, cast(source_size as bigint) as source_size, target, cast(epochs * size + greatest(0, least(size, due - before)) as bigint) as taken from x""",
    "op6_chat_format": r"""
with d as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (
  select conv_id, count(*) as n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn nulls first, role, text) as text,
    string_agg(md5(role || chr(0) || text), '' order by turn nulls first, role, text) as key
  from d group by conv_id),
g as (select key, n_turns, text, min(conv_id) as conv_id, count(*) as copies from c group by key, n_turns, text),
p as (select distinct substr(key, 1, cast(32 * k as bigint)) as key from (select key, unnest(range(1, n_turns)) as k from c))
select conv_id, n_turns, copies, text from g where key not in (select key from p)""",
    "op3_ngram_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end as g
  from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as d, doc_id as o from n union select l.b, r.o from r join l on l.a = r.d),
m as (select d, min(o) as o from r group by d)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.o, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join m on m.d = w.doc_id""",
    "op8_embedding_neardup": r"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id as d, vec_id as o from v union select l.b, r.o from r join l on l.a = r.d),
m as (select d, min(o) as o from r group by d), k as (select a, count(*) as n from l group by a)
select e.vec_id, cast(coalesce(k.n, 0) as bigint) as n_links, coalesce(m.o, e.vec_id) as component_id, e.vec_id = coalesce(m.o, e.vec_id) as kept
from embeddings e left join k on k.a = e.vec_id left join m on m.d = e.vec_id""",
}
