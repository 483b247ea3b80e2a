"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
with p as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
marks as (
  select doc_id as page_id, min(case when quality = 1 and coalesce(toxic, 0) = 0 then 1 else 0 end) as good
  from labels where doc_id is not null and quality is not null group by doc_id),
n as (
  select host, count(good) as n, coalesce(sum(good), 0)::bigint as k,
    regexp_replace(regexp_extract(host, '[^@]*$'), ':[0-9]*$', '') as name
  from p left join marks using (page_id) group by host),
x as (
  select *, case when regexp_full_match(name, '[0-9.]+') then '' else coalesce(
      (select max(suffix) from (values ('ac.uk'), ('co.uk'), ('gov.uk'), ('org.uk'), ('com.au'), ('net.au'), ('org.au'),
        ('co.nz'), ('co.jp'), ('ne.jp'), ('or.jp'), ('co.kr'), ('com.br'), ('com.cn'), ('com.mx'), ('com.tr'), ('co.in'),
        ('co.za')) as v(suffix) where name = suffix or ends_with(name, '.' || suffix)),
      regexp_extract(name, '[^.]*$')) end as suffix from n),
h as (
  select host, n, k, suffix, case when suffix = '' then name when name = suffix then name
    else regexp_extract(left(name, length(name) - length(suffix) - 1), '[^.]*$') || '.' || suffix end as domain from x),
d as (select domain, suffix, sum(n)::bigint as dn, sum(k)::bigint as dk from h group by all),
s as (select suffix, sum(dn)::bigint as sn, sum(dk)::bigint as sk from d group by all),
dd as (select d.*, sn from d join s using (suffix)),
hh as (select h.*, dn from h join d using (domain, suffix)),
m as (
  select n, k, case when n > 0 then k / n else 1.0::double end as rate, sa, sb, sc, da, db, dc, ha, hb, hc
  from (select coalesce(sum(sn), 0)::double as n, coalesce(sum(sk), 0)::double as k from s),
    (select coalesce(sum((sk::double * sk / sn)::decimal(38, 9)), 0)::double as sa,
      coalesce(sum((sn::double * sn / (select sum(sn)::double from s))::decimal(38, 9)), 0)::double as sb,
      count(*)::double as sc from s where sn > 0),
    (select coalesce(sum((dk::double * dk / dn)::decimal(38, 9)), 0)::double as da,
      coalesce(sum((dn::double * dn / sn)::decimal(38, 9)), 0)::double as db, count(*)::double as dc from dd where dn > 0),
    (select coalesce(sum((k::double * k / n)::decimal(38, 9)), 0)::double as ha,
      coalesce(sum((n::double * n / dn)::decimal(38, 9)), 0)::double as hb, count(*)::double as hc from hh where n > 0)),
ms as (
  select *, (sa - k * rate) / (sc - 1) as s_between, (k - sa) / (n - sc) as s_within, (n - sb) / (sc - 1) - 1 as s_size,
    (da - sa) / (dc - sc) as d_between, (k - da) / (n - dc) as d_within, (n - db) / (dc - sc) - 1 as d_size,
    (ha - da) / (hc - dc) as h_between, (k - ha) / (n - hc) as h_within, (n - hb) / (hc - dc) - 1 as h_size from m),
rho as (
  select rate,
    case when sc > 1 and n > sc and s_between + s_size * s_within > 0
      then (s_between - s_within) / (s_between + s_size * s_within) else 0 end as rs,
    case when dc > sc and n > dc and d_between + d_size * d_within > 0
      then (d_between - d_within) / (d_between + d_size * d_within) else 0 end as rd,
    case when hc > dc and n > hc and h_between + h_size * h_within > 0
      then (h_between - h_within) / (h_between + h_size * h_within) else 0 end as rh from ms),
prior as (
  select rate, 1 / least(greatest(rs, 0.05::double), 0.5::double) - 1 as ms,
    1 / least(greatest(rd, 0.05::double), 0.5::double) - 1 as md,
    1 / least(greatest(rh, 0.05::double), 0.5::double) - 1 as mh from rho),
rates as (
  select host, n, k, mh, rate,
    (md * ((ms * rate + sk) / (ms + sn)) + dk) / (md + dn) as drate
  from h join d using (domain, suffix) join s using (suffix), prior),
post as (select host, n, rate, mh * drate + k as a, mh * (1 - drate) + n - k as b from rates),
bound as (
  select host, n, rate, a / (a + b) as mean, a / (a + b) + 1.0::double * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) as upper
  from post),
rules(verdict, rule, own, prefix) as (values
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'),
  ('block', 'net/fr/', 'net', '/fr/')),
fit as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(r.verdict, length(rule)) as verdict
  from p join rules r on (p.host = own or ends_with(p.host, '.' || own)) and starts_with(p.path, prefix) group by page_id)
select p.page_id, p.host, p.path, fit.rule,
  coalesce(fit.verdict, case when upper < rate then 'block' else 'allow' end) as verdict, bound.n,
  round(mean, 9) as good_mean, round(upper, 9) as good_upper
from p left join bound using (host) left join fit using (page_id)
"""

OP3 = r"""
with d as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as i, len(l) as m from d),
hashed as (select *, ('0x' || substr(md5(line), 1, 10))::bigint % 2147483647 as h from lines),
rolled as (
  select *, (h + coalesce(lag(h, 1) over w, 0) * 1000003 % 2147483647
    + coalesce(lag(h, 2) over w, 0) * 1426104154 % 2147483647 + coalesce(lag(h, 3) over w, 0) * 1049561761 % 2147483647) % 2147483647 as roll
  from hashed window w as (partition by doc_id order by i)),
ended as (select *, i = m - 1 or roll % 3 = 0 as fin from rolled),
numbered as (
  select *, coalesce(sum(fin::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as num
  from ended),
chunks as (
  select doc_id, num, string_agg(line, chr(10) order by i) as c, count(*) as n, count(*) > 1 as passage
  from numbered group by all),
marked as (
  select *, passage and regexp_matches(c, '[^ \t\n\x0B\f\r]')
    and row_number() over (partition by c, passage order by doc_id, num) > 1 as gone from chunks),
kept as (
  select doc_id, string_agg(c, chr(10) order by num) filter (where not gone) as t, sum(n)::bigint as n_lines,
    coalesce(sum(n) filter (where gone), 0)::bigint as n_removed from marked group by doc_id)
select doc_id, case when text is null then 0 else n_lines end as n_lines, n_removed,
  case when text is null then null else coalesce(t, '') end as text
from d join kept using (doc_id)
"""

OP3_PASSAGES = r"""
with d as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as i from d),
worded as (select * from (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from lines) where n > 0),
placed as (select *, sum(n) over (partition by doc_id order by i rows unbounded preceding)::bigint as done from worded),
framed as (
  select doc_id,
    case when sum(n) over ahead >= 50 then {'a': min(i) over ahead, 'b': max(i) over ahead, 'k': list(line) over ahead} end as x,
    case when sum(n) over behind >= 50 then {'a': min(i) over behind, 'b': max(i) over behind, 'k': list(line) over behind} end as y
  from (select *, done - n as begun from placed)
  window ahead as (partition by doc_id order by begun range between current row and 49 following),
    behind as (partition by doc_id order by done range between 49 preceding and current row)),
runs as (
  select distinct doc_id, r.a as a, r.b as b, array_to_string(r.k, chr(10)) as k
  from (select doc_id, unnest([x, y]) as r from framed) where r is not null),
ranked as (
  select *, count(*) over (partition by k) as times, first_value(doc_id) over w as first_id, first_value(a) over w as first_a, first_value(b) over w as first_b
  from runs window w as (partition by k order by doc_id, a, b)),
spans as (
  select doc_id, case when doc_id = first_id then greatest(a, first_b + 1) else a end as a, b
  from ranked where times > 1 and not (doc_id = first_id and a = first_a)),
gone as (select distinct doc_id, unnest(range(a, b + 1)) as i from spans where a <= b),
kept as (
  select doc_id, string_agg(line, chr(10) order by i) filter (where g is null) as t, count(*) as n_lines, count(g) as n_removed
  from (select lines.*, gone.i as g from lines left join gone using (doc_id, i)) group by doc_id)
select doc_id, case when text is null then 0 else n_lines end as n_lines, n_removed, case when text is null then null else coalesce(t, '') end as text
from d join kept using (doc_id)
"""

OP6 = r"""
with d as (
  select doc_id, coalesce('s' || source, 't') as skey,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(md5(concat_ws(':', '7', coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, '')))), 1, 15))::bigint as h
  from documents),
s as (select skey, sum(size)::bigint as source_size, row_number() over (order by skey) as n from d group by skey),
w as (select *, (n - 1) % 3 + 1 as weight, source_size * 3 as cap from s),
f as (
  select *, sum(source_size) over () as total, sum(weight) over () as all_weight,
    coalesce(sum(cap) over (order by cap::double / weight, skey rows between unbounded preceding and 1 preceding), 0) as spent,
    coalesce(sum(weight) over (order by cap::double / weight, skey rows between unbounded preceding and 1 preceding), 0) as used from w),
l as (select *, max((total - spent)::double / (all_weight - used)::double) over () as level from f),
goal as (
  select skey, n, source_size, total::bigint as total, least(cap::double, level * weight) as target, shard,
    floor(floor(total::double / 16 + 0.5) * shard / 8) as house, ceil(source_size::double / 16)::bigint as blocks
  from l, range(1, 9) as r(shard)),
b as (
  select *, case when house > 0 then target * house / total::double else 0 end as share,
    case when house > 0 then count(*) over (partition by shard) / house else 0 end as slack from goal),
bounds as (
  select *, floor(share * greatest(1 - slack, 0) + 0.5)::bigint as low,
    case when house > 0 then floor(share * (1 + slack) + 0.5)::bigint + 1 else 0 end as high from b),
ranked as (
  select shard, skey, row_number() over (partition by shard order by target / (2 * k + 1) desc, n, k) as rank
  from (select *, unnest(range(low, high)) as k from bounds)),
open as (select shard, any_value(house) - sum(low) as seats from bounds group by shard),
won as (select shard, skey, count(*) as won from ranked join open using (shard) where rank <= seats group by all),
seats as (
  select shard, skey, source_size, target, blocks, least(low + coalesce(won, 0), 3 * blocks)::bigint as seats
  from bounds left join won using (shard, skey)),
run as (
  select skey, any_value(source_size) as source_size, any_value(target) as target, any_value(blocks) as blocks,
    list(seats order by shard) as ends, max(seats) as last from seats group by skey),
pos as (
  select *, sum(size) over (partition by skey order by h, doc_id, size rows between unbounded preceding and current row) - size as pos from d),
taken as (
  select *, (case when blocks > 0 then last // blocks else 0 end * size
    + greatest(0, least(size, case when blocks > 0 then last % blocks else 0 end * 16 - pos)))::bigint as taken
  from pos join run using (skey))
select doc_id, size, source_size, target, taken,
  case when taken > 0 then len(list_filter(ends, lambda e: e <= pos // 16)) + 1 end as first_shard
from taken
"""

OP7 = """
with d as (select doc_id, sha256(coalesce(text, '')) as h from documents),
g as (select h, max(doc_id) as keep_id, count(*) as group_size from d group by h)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256
from d join g using (h)
"""

OP9 = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
best as (select payload_digest, max(page_id) as best from p where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when page_id <> best then 'revisit' else 'response' end as record_type,
  case when page_id <> best then best end as refers_to
from p left join best using (payload_digest)
"""

ORACLE_SQL = {
    "op1_url_filter": OP1,
    "op3_line_dedup": OP3,
    "op3_shared_passages": OP3_PASSAGES,
    "op6_mixing": OP6,
    "op7_exact_dedup": OP7,
    "op9_warc": OP9,
}
