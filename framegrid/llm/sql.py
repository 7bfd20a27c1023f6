"""DuckDB SQL for the text operators' queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_quality_rules"] = r"""
with d as (select doc_id, source as host, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
tri as (select doc_id, g, list(i order by i) as places from (
          select doc_id, unnest(range(1, len(ws) - 1)) as i, ws[i:i + 2] as g from w where len(ws) > 2) group by doc_id, g having count(*) > 1),
rep as (select doc_id, count(distinct i + k) as n from (select doc_id, unnest(places) as i from tri), range(3) r(k) group by doc_id),
f as (select w.doc_id, host, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
      from w left join rep using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
r as (select *, base_failed as r1, n_symbols > 0.1 * greatest(word_chars, 1) as r2, n_dup_lines > 0.3 * greatest(n_lines, 1) as r3,
        n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words) as r4 from b),
h as (select host, k, count(*)::double as n, count(*) filter (f)::double as x
      from (select host, unnest([1, 2, 3, 4]) as k, unnest([r1, r2, r3, r4]) as f from r) group by host, k),
p as (select k, sum(x) / sum(n) as m, count(*) as hs, sum(n) as nn, sum(n * n) as n2, sum(x * x / n) as q, sum(x) as xx from h group by k),
v as (select k, m, case when nn - n2 / nn > 0 then (q - xx * xx / nn - (hs - 1) * m * (1 - m)) / (nn - n2 / nn) end as var from p),
s as (select k, m, case when var > 0 then least(1e6, greatest(1e-6, m * (1 - m) / var - 1)) else 1e6 end as size from v),
bad as (select host, bool_or((x + m * size) / (n + size) > 0.5) as host_failed from h join s using (k) group by host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_failed as kept
from r join bad on r.host is not distinct from bad.host
"""

ORACLES["op5_mixing"] = r"""
with d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, ([3.0, 1.0, 2.0])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from d group by source),
f as (select *, 2.0::double * source_size as full_, 2.0::double * source_size / w as level from s),
c as (select *, coalesce(sum(full_) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0) as taken,
        sum(w) over () - coalesce(sum(w) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
        1.5::double * sum(source_size) over () as goal from f),
g as (select coalesce((select arg_min((goal - taken) / rest, level) from c where (goal - taken) / rest <= level), 'inf'::double) as water),
t as (select source, source_size, least(full_, water * w) as target from c, g),
r as (select *, case when source_size > 0 then least(target / source_size, 2.0) else 0.0 end as rate from t)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0::double < rate - floor(rate) then 1 else 0 end))::bigint as taken
from d join r on d.source is not distinct from r.source
"""

ORACLES["op6_minhash"] = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
sh as materialized (select distinct doc_id, md5(array_to_string(ws[i:i + 3], ' ')) as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from d where len(ws) > 0)),
n as materialized (select doc_id, count(*) as n from sh group by doc_id),
e as materialized (select a.doc_id as u, b.doc_id as v from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
      group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
sym as materialized (select u, v from e union all select v, u from e),
reach(a, b) as (select u, v from sym union select reach.a, sym.v from reach join sym on reach.b = sym.u),
m as (select a, least(a, min(b)) as c from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, d.doc_id) as component_id, coalesce(m.c, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join m on m.a = d.doc_id
"""

ORACLES["op4_embedding_dedup"] = r"""
with recursive x as materialized (select vec_id, list_transform(embedding, lambda e: e::double) as v, label from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
e as materialized (select a.vec_id as u, b.vec_id as v from x a join x b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) as (select u, v from e union select reach.a, e.v from reach join e on reach.b = e.u),
m as (select a, least(a, min(b)) as c from reach group by a),
n as (select u, count(*) as n from e group by u)
select t.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(m.c, t.vec_id) as component_id, coalesce(m.c, t.vec_id) = t.vec_id as kept
from embeddings t left join n on n.u = t.vec_id left join m on m.a = t.vec_id
"""

ORACLES["op9_substring_dedup"] = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
g as materialized (select doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13)),
f as materialized (select h, min(doc_id) as first from g group by h),
c as materialized (select distinct doc_id, i + k as i from (select g.doc_id, g.i from g join f using (h) where f.first < g.doc_id), range(13) r(k)),
w as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from d),
k as (select w.doc_id, count(*) as n, string_agg(w.w, ' ' order by w.i) as t from w anti join c on w.doc_id = c.doc_id and w.i = c.i group by w.doc_id)
select d.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from d left join k using (doc_id)
"""

ORACLES["op10_warc"] = r"""
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest, payload_bytes, max(page_id) as last from p where payload_bytes >= 1000 group by all)
select page_id, p.payload_bytes, p.payload_digest, case when last <> page_id then 'revisit' else 'response' end as record_type,
  case when last <> page_id then last end as refers_to
from p left join m using (payload_digest, payload_bytes)
"""
