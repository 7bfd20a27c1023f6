"""Common table expressions of the queries' SQL: the proxy views in DuckDB."""

TRACK = """with recursive track as (select user_id as clip_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as frame_idx, case when event_type <> 'error' then value end as value, event_type from events) """

FILLED = TRACK + """, filled as (select clip_id, frame_idx, coalesce(last_value(value ignore nulls) over (w rows between unbounded preceding and current row), first_value(value ignore nulls) over (w rows between current row and unbounded following)) as v from track window w as (partition by clip_id order by frame_idx)) """

GRID = """with recursive fr as (select label as clip_id, (row_number() over (partition by label order by vec_id) - 1)::int as frame_idx, list_transform(embedding, lambda v: floor(greatest(0e0, least(255e0, (v::double * 2 + 0.5e0) * 255)))::int) as data from embeddings),
px as (select clip_id, frame_idx, (p // 8)::int as y, (p % 8)::int as x, data[p + 1] as a, data[p + 1] as r, data[(p + 21) % 64 + 1] as g, data[(p + 42) % 64 + 1] as b from fr, range(64) t(p)) """

DIST = GRID + """, uv as (select *, (b - (0.299e0 * r + 0.587e0 * g + 0.114e0 * b)) * 0.564e0 + 128 as u, (r - (0.299e0 * r + 0.587e0 * g + 0.114e0 * b)) * 0.713e0 + 128 as v from px), dp as (select *, sqrt(pow((u - 128) / 5, 2) + pow((v - 128) / 5, 2)) as d from uv) """

CLIPPED = DIST + """, rg as (select clip_id, u, v from dp where y < 2 or y > 5 or x < 2 or x > 5),
m1 as (select clip_id, median(u) as mu_u, median(v) as mu_v from rg group by 1),
s1 as (select clip_id, mu_u, mu_v, greatest(1, median(abs(u - mu_u)) * 1.4826e0) as sd_u, greatest(1, median(abs(v - mu_v)) * 1.4826e0) as sd_v from rg join m1 using (clip_id) group by all),
k1 as (select clip_id, u, v from rg join s1 using (clip_id) where sqrt(pow((u - mu_u) / sd_u, 2) + pow((v - mu_v) / sd_v, 2)) < 5),
m2 as (select clip_id, median(u) as mu_u, median(v) as mu_v from k1 group by 1),
s2 as (select clip_id, mu_u, mu_v, greatest(1, median(abs(u - mu_u)) * 1.4826e0) as sd_u, greatest(1, median(abs(v - mu_v)) * 1.4826e0) as sd_v from k1 join m2 using (clip_id) group by all),
st as (select *, share > 0.98e0 as flat from (select s2.*, avg((sqrt(pow((u - mu_u) / sd_u, 2) + pow((v - mu_v) / sd_v, 2)) < 8)::int) as share from rg join s2 using (clip_id) group by all)) """

COMPONENTS = GRID + """, fg as materialized (select clip_id, frame_idx, y, x, y * 8 + x as p from px where a > 127),
nb as materialized (select a.clip_id, a.frame_idx, a.p, b.p as q from fg a join fg b on a.clip_id = b.clip_id and a.frame_idx = b.frame_idx and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
re(clip_id, frame_idx, p, q) as (select clip_id, frame_idx, p, q from nb union select re.clip_id, re.frame_idx, re.p, nb.q from re join nb on nb.clip_id = re.clip_id and nb.frame_idx = re.frame_idx and nb.p = re.q),
lab as materialized (select clip_id, frame_idx, p, (p // 8)::int as y, (p % 8)::int as x, min(q)::int as label from re group by all) """

HOLES = GRID + """, bgr as materialized (select clip_id, frame_idx, y, x, y * 8 + x as p from px where a <= 127),
nb as materialized (select a.clip_id, a.frame_idx, a.p, b.p as q from bgr a join bgr b on a.clip_id = b.clip_id and a.frame_idx = b.frame_idx and abs(a.y - b.y) + abs(a.x - b.x) = 1),
reached(clip_id, frame_idx, p) as (select clip_id, frame_idx, p from bgr where y in (0, 7) or x in (0, 7) union select r.clip_id, r.frame_idx, nb.q from reached r join nb on nb.clip_id = r.clip_id and nb.frame_idx = r.frame_idx and nb.p = r.p) """

JOBS = """with job as (select o_orderkey as job_id, case o_orderstatus when 'F' then 'done' when 'O' then 'queued' else 'running' end as status, o_orderdate as created_at, o_totalprice as price from orders),
clip as (select l_orderkey as job_id, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::int as clip_no, case l_returnflag when 'A' then 'done' when 'N' then 'pending' else 'failed' end as status, l_quantity::int as frames, l_extendedprice as work, l_partkey as part, l_discount as fraction from lineitem) """

# The scenes: a flat backdrop around a subject in the middle, but in every fifth clip.
SCENE = GRID + """, sc as materialized (select clip_id, frame_idx, y, x, a, case when fl then 40 + clip_id * 3 + a % 3 else r end as r, case when fl then 180 + a % 5 + 20 * (a % 83 = 7)::int else g end as g, case when fl then 60 + a % 4 else b end as b
  from (select *, clip_id % 5 > 0 and not (y between 2 and 5 and x between 2 and 5 and a >= 90) as fl from px)),
su as materialized (select *, (b - (0.299e0 * r + 0.587e0 * g + 0.114e0 * b)) * 0.564e0 + 128 as u, (r - (0.299e0 * r + 0.587e0 * g + 0.114e0 * b)) * 0.713e0 + 128 as v from sc) """


def backdrop(pixels: str) -> str:
    """Statistics ``st`` of the border pixels of the table ``pixels``, in two rounds."""
    return f""", rg as materialized (select clip_id, u, v from {pixels} where y < 2 or y > 5 or x < 2 or x > 5),
m1 as (select clip_id, median(u) as mu_u, median(v) as mu_v from rg group by 1),
s1 as (select clip_id, mu_u, mu_v, greatest(1, median(abs(u - mu_u)) * 1.4826e0) as sd_u, greatest(1, median(abs(v - mu_v)) * 1.4826e0) as sd_v from rg join m1 using (clip_id) group by all),
k1 as (select clip_id, u, v from rg join s1 using (clip_id) where sqrt(pow((u - mu_u) / sd_u, 2) + pow((v - mu_v) / sd_v, 2)) < 5),
m2 as (select clip_id, median(u) as mu_u, median(v) as mu_v from k1 group by 1),
s2 as (select clip_id, mu_u, mu_v, greatest(1, median(abs(u - mu_u)) * 1.4826e0) as sd_u, greatest(1, median(abs(v - mu_v)) * 1.4826e0) as sd_v from k1 join m2 using (clip_id) group by all),
st as materialized (select *, share > 0.98e0 as flat, sqrt(pow(mu_u - 128, 2) + pow(mu_v - 128, 2)) as saturation, sqrt(pow((128 - mu_u) / sd_u, 2) + pow((128 - mu_v) / sd_v, 2)) as neutral
  from (select s2.*, avg((sqrt(pow((u - mu_u) / sd_u, 2) + pow((v - mu_v) / sd_v, 2)) < 8)::int) as share from rg join s2 using (clip_id) group by all)) """


KEYED = SCENE + """, nf as (select clip_id, count(*) as n from fr group by 1),
ks as (select distinct clip_id, round_even(i * (n - 1) / 23e0, 0)::int as frame_idx from nf, range(24) r(i)),
sp as materialized (select * from su semi join ks using (clip_id, frame_idx))""" + backdrop("sp") + """,
sd as materialized (select sp.*, sqrt(pow((u - mu_u) / sd_u, 2) + pow((v - mu_v) / sd_v, 2)) as d, greatest(4e0, 0.5e0 * neutral) as hi from sp join st using (clip_id)),
sides as (select * from sd where y < 2 union all select * from sd where y > 5 union all select * from sd where x < 2 union all select * from sd where x > 5),
bg as (select clip_id, coalesce(median(r) filter (d < 3), median(r)) as bg_r, coalesce(median(g) filter (d < 3), median(g)) as bg_g, coalesce(median(b) filter (d < 3), median(b)) as bg_b from sides group by 1),
op as (select clip_id, frame_idx, y, x from sd where d > hi),
far as (select clip_id, quantile_cont(d, 0.999) as p999 from sd where not exists (select 1 from op where op.clip_id = sd.clip_id and op.frame_idx = sd.frame_idx and (op.y - sd.y) * (op.y - sd.y) + (op.x - sd.x) * (op.x - sd.x) <= 2.56e0) group by 1),
lo as (select st.*, bg_r, bg_g, bg_b, p999, greatest(4e0, 0.5e0 * neutral) as hi, case when p999 is null then 3e0 else least(greatest(3e0, p999), greatest(3e0, greatest(4e0, 0.5e0 * neutral) / 2)) end as t_lo from st join bg using (clip_id) left join far using (clip_id)),
km as materialized (select *, greatest(t_lo + 1, hi) as t_hi, flat and saturation >= 20 as safe from lo) """

#: lab: components by eight neighbours of the places in fg, named by their first place.
LABELS = """, nb8 as materialized (select a.clip_id, a.frame_idx, a.p, b.p as q from fg a join fg b on a.clip_id = b.clip_id and a.frame_idx = b.frame_idx and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
re(clip_id, frame_idx, p, q) as (select clip_id, frame_idx, p, q from nb8 union select re.clip_id, re.frame_idx, re.p, nb8.q from re join nb8 on nb8.clip_id = re.clip_id and nb8.frame_idx = re.frame_idx and nb8.p = re.q),
lab as materialized (select clip_id, frame_idx, p, (p // 8)::int as y, (p % 8)::int as x, min(q)::int as label from re group by all) """

#: cl: the length of the outer contours by frame, of the components lab that touch the background reached from outside.
CONTOURS = """, ou as (select distinct l.clip_id, l.frame_idx, l.label from lab l where y in (0, 7) or x in (0, 7)
  or exists (select 1 from reached r where r.clip_id = l.clip_id and r.frame_idx = l.frame_idx and abs(r.p // 8 - l.y) + abs(r.p % 8 - l.x) = 1)),
di(m, dy, dx) as (values (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)),
tn as (select f.clip_id, f.frame_idx, f.p, i.m, arg_min(di.m, (di.m - i.m + 11) % 8) as go from fg f, range(8) i(m), di, fg g
  where g.clip_id = f.clip_id and g.frame_idx = f.frame_idx and g.y = f.y + di.dy and g.x = f.x + di.dx group by all),
tq as materialized (select tn.*, tn.p + dy * 8 + dx as q from tn join di on di.m = tn.go),
wk(clip_id, frame_idx, label, p, m) as (select ou.clip_id, ou.frame_idx, ou.label, tq.q, tq.go from ou join tq on tq.clip_id = ou.clip_id and tq.frame_idx = ou.frame_idx and tq.p = ou.label and tq.m = 0
  union select wk.clip_id, wk.frame_idx, wk.label, tq.q, tq.go from wk join tq on tq.clip_id = wk.clip_id and tq.frame_idx = wk.frame_idx and tq.p = wk.p and tq.m = wk.m),
cl as materialized (select clip_id, frame_idx, count(*) filter (m % 2 = 0) + count(*) filter (m % 2 = 1) * sqrt(2e0) as len from wk group by all) """


def flow(table: str = "px", steps: str = "(-1), (1)") -> str:
    """fw: by pixel the displacement to the frame before (k = -1) or after (k = 1), an exhaustive search; al: the alpha there."""
    return f""", gy as materialized (select clip_id, frame_idx, y, x, a, (299 * r + 587 * g + 114 * b + 500) // 1000 as v from {table}),
df as materialized (select p.clip_id, p.frame_idx, k, p.y, p.x, dy, dx, (p.v - q.v) * (p.v - q.v) as e
  from gy p, (values {steps}) t(k), (values (-1), (0), (1)) u(dy), (values (-1), (0), (1)) w(dx), gy q
  where q.clip_id = p.clip_id and q.frame_idx = p.frame_idx + k and q.y = greatest(0, least(7, p.y + dy)) and q.x = greatest(0, least(7, p.x + dx))),
cs as (select o.clip_id, o.frame_idx, o.k, o.y, o.x, o.dy, o.dx, sum(n.e) as c
  from df o join df n on n.clip_id = o.clip_id and n.frame_idx = o.frame_idx and n.k = o.k and n.dy = o.dy and n.dx = o.dx and abs(n.y - o.y) <= 1 and abs(n.x - o.x) <= 1 group by all),
fw as materialized (select clip_id, frame_idx, k, y, x, arg_min(dy, (c, dy * dy + dx * dx, dy, dx)) as fy, arg_min(dx, (c, dy * dy + dx * dx, dy, dx)) as fx from cs group by all),
al as materialized (select fw.*, q.a as other from fw join {table} q on q.clip_id = fw.clip_id and q.frame_idx = fw.frame_idx + fw.k
  and q.y = greatest(0, least(7, fw.y + fy)) and q.x = greatest(0, least(7, fw.x + fx))) """
