"""The queries of this package in the SQL of another engine, where SQL can express them."""

_STRENGTH = """
  select case when count(*) < 2 or sum(n) <= count(*) then 10.0
    else case when (sum(good * good / n::double) - sum(good) ** 2 / sum(n)::double) / (count(*) - 1)
                <= sum(good * (1 - good / n::double)) / (sum(n) - count(*)) then 10000.0
      else least(10000.0, greatest(1.0, 1 / (
        ((sum(good * good / n::double) - sum(good) ** 2 / sum(n)::double) / (count(*) - 1) - sum(good * (1 - good / n::double)) / (sum(n) - count(*)))
        / ((sum(good * good / n::double) - sum(good) ** 2 / sum(n)::double) / (count(*) - 1)
           + ((sum(n) - sum(n * n) / sum(n)::double) / (count(*) - 1) - 1) * sum(good * (1 - good / n::double)) / (sum(n) - count(*)))
      ) - 1)) end end as c
  from {0} where n > 0"""

_OP3 = f"""
with parsed as (
  select page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages)),
ruled as (
  select *, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule
  from parsed),
once as (select doc_id as page_id, min(quality) as good from labels where doc_id is not null and quality is not null group by 1),
counts as (select host, count(*) as n, sum(good) as good from parsed join once using (page_id) group by 1),
named as (
  select host, coalesce(n, 0) as n, coalesce(good, 0)::bigint as good,
    regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]$', '') as name
  from (select distinct host from parsed) left join counts using (host)),
suffixed as (
  select *, string_split(name, '.') as labels, case
    when regexp_matches(name, '^([0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}|\\[.*\\])$') then '[address]'
    when regexp_matches(name, '(^|[.])(ac|co|com|edu|go|gob|gov|mil|ne|net|or|org)[.][a-z][a-z]$') then array_to_string(list_slice(string_split(name, '.'), -2, -1), '.')
    else list_extract(string_split(name, '.'), -1) end as suffix
  from named),
h as (
  select host, n, good, suffix, case when suffix = '[address]' then name
    else array_to_string(list_slice(labels, greatest(1, len(labels) - len(string_split(suffix, '.'))), len(labels)), '.') end as domain
  from suffixed),
d as (select domain, suffix, sum(n)::bigint as n, sum(good)::bigint as good from h group by all),
s as (select suffix, sum(n)::bigint as n, sum(good)::bigint as good from d group by all),
o as (select case when sum(n) > 0 then sum(good) / sum(n)::double else 1.0 end as overall from s),
ch as ({_STRENGTH.format("h")}), cd as ({_STRENGTH.format("d")}), cs as ({_STRENGTH.format("s")}),
sm as (select suffix, (good + cs.c * overall) / (n + cs.c) as suffix_mean from s, cs, o),
dm as (select domain, suffix, (good + cd.c * suffix_mean) / (n + cd.c) as domain_mean from d join sm using (suffix), cd),
hm as (select host, n, ch.c as c, (good + ch.c * domain_mean) / (n + ch.c) as m from h join dm using (domain, suffix), ch),
u as (select host, m + 1.645 * sqrt(m * (1 - m) / (n + c + 1)) as upper from hm)
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when upper < 0.5 then 'block' else 'allow' end as verdict,
  round(upper, 6) as upper
from ruled join u using (host)"""

_OP6 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, text from documents),
s as (
  select source, sum(size)::bigint as source_size,
    ([3.0, 1.0, 2.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from d group by source),
c as (select *, 2.0 * source_size as cap, 2.0 * source_size / w as fills_at, 1.5 * sum(source_size) over () as total from s),
-- A level at which the sources that fill before it are full and the others share the rest by weight.
r as (
  select *, coalesce(sum(cap) over (order by fills_at, source nulls last rows between unbounded preceding and 1 preceding), 0) as given,
    sum(w) over (order by fills_at, source nulls last rows between current row and unbounded following) as open_w,
    row_number() over (order by fills_at, source nulls last) as rn
  from c),
level as (select coalesce(arg_min((total - given) / open_w, rn) filter ((total - given) / open_w <= fills_at), max(fills_at)) as level from r),
t as (select source, source_size, least(cap, w * level) as target from c, level),
k as (
  select d.doc_id, d.source, d.size, t.source_size, t.target,
    row_number() over (partition by d.source order by d.size, d.doc_id nulls first) as k,
    case when t.source_size > 0 then t.target / t.source_size else 0.0 end as each,
    ('0x' || substr(md5('7|' || coalesce('s' || d.source, 'n')), 1, 12))::bigint / 281474976710656.0 as u
  from d join t on d.source is not distinct from t.source)
select doc_id, source, size, source_size, target,
  (floor(u + each * k) - floor(u + each * (k - 1)))::bigint as copies,
  (floor(u + each * k) - floor(u + each * (k - 1)))::bigint * size as taken
from k"""

_OP11 = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) as term from d),
kept as (select lang, term, count(*)::hugeint as n from w group by all having count(distinct id) >= 30),
l as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
g as (select distinct lang, source from d),
n as (select lang, source, term, count(*)::hugeint as n from w join kept using (lang, term) group by all),
t as (select g.lang, g.source, coalesce(sum(n.n), 0)::hugeint as total from g left join n using (lang, source) group by all),
-- Every group gives every kept term a share, be it found there or not.
p as (
  select t.lang, t.source, kept.term, coalesce(n.n, 0) as n,
    1 + 1000000000::hugeint * (coalesce(n.n, 0) + 5) // (t.total + 5 * l.v) as p,
    1 + 1000000000::hugeint * (kept.n + 5) // (l.total + 5 * l.v) as q
  from t join l using (lang) join kept using (lang) left join n on n.lang = t.lang and n.source = t.source and n.term = kept.term),
pair as (
  select a.lang, a.source, b.source as item, coalesce(f.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) f
  on f.lang = a.lang and f.source = a.source and f.item = b.source)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, encode(item)))::int as rank from pair
union all
select * from (
  select lang, source, 'term' as part, term as item, (p - q)::bigint as value,
    (row_number() over (partition by lang, source order by p - q desc, encode(term)))::int as rank
  from p where n > 0 and p > q) where rank <= 50"""

_CRC32 = """xor(list_reduce(
      flatten(list_transform(string_split({0}, ''), lambda c: [ord(c)::ubigint, {1}])),
      lambda a, x: case when x < 256 then xor(a, x) when a % 2 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end,
      4294967295::ubigint), 4294967295::ubigint)""".format("{0}", ", ".join(["256::ubigint"] * 8))

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# One step of the lattice over whole audits: labels of the four states after a row, then after inserts.
_OP13 = f"""
with recursive
o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
k as (select *, {_CRC32.format("key")} % 20 as kind from o),
r as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case when kind = 3 then [1, 2] else [1] end) as copy from k where kind <> 0)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i,
    count(*) over (partition by conv_id) as n, right(rtrim(text, {_BLANK}), 1) as last from r),
faulty as (
  select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    lead(role) over (partition by conv_id order by i) as following from placed),
f as (
  select *, case when last = '' then 2 when again then 3 when last not in ('.', '!', '?') then 1 else 0 end as fault from faulty),
steps as (
  select conv_id, 0::bigint as i, {{'c': 0, 'a': ''}} as l0, {{'c': 1000000, 'a': ''}} as l1, {{'c': 3, 'a': 'I'}} as l2, {{'c': 6, 'a': 'II'}} as l3
  from (select distinct conv_id from f)
  union all
  select conv_id, i, n0, n1, m2, list_min([n3, {{'c': m2.c + 3, 'a': m2.a || 'I'}}])
  from (
    select *, list_min([n2, {{'c': list_min([n0, n1, n3]).c + 3, 'a': list_min([n0, n1, n3]).a || 'I'}}]) as m2
    from (
      select s.conv_id, f.i,
        {{'c': l0.c + 4, 'a': l0.a || 'D'}} as n0,
        list_min([{{'c': l1.c + 4, 'a': l1.a || 'D'}}, {{'c': l0.c + case when left(role, 1) = 's' then stay else 1000000 end, 'a': l0.a || 'K'}}]) as n1,
        list_min([
          {{'c': l2.c + 4, 'a': l2.a || 'D'}},
          {{'c': list_min([l0, l1, l3]).c + case when left(role, 1) = 'u' then stay else 1000000 end, 'a': list_min([l0, l1, l3]).a || 'K'}},
          {{'c': list_min([l0, l1, l3]).c + 3 + stay, 'a': list_min([l0, l1, l3]).a || 'R'}}]) as n2,
        list_min([
          {{'c': l3.c + 4, 'a': l3.a || 'D'}},
          {{'c': l2.c + case when left(role, 1) = 'a' then stay else 1000000 end, 'a': l2.a || 'K'}},
          {{'c': l2.c + 3 + stay, 'a': l2.a || 'R'}}]) as n3
      from steps s join (select *, case when fault > 1 then 1000000 when fault = 1 then 3 else 0 end as stay from f) f
        on f.conv_id is not distinct from s.conv_id and f.i = s.i + 1))),
solved as (
  select s.conv_id, list_min([l0, l3]).c as cost, list_min([l0, l3]).a as audit
  from steps s join (select conv_id, max(n) as n from f group by conv_id) e on e.conv_id is not distinct from s.conv_id and e.n = s.i),
edits as (select conv_id, unnest(range(1, len(audit) + 1)) as j, audit, unnest(string_split(audit, '')) as edit from solved where audit <> ''),
walked as (select *, count(*) filter (where edit <> 'I') over (partition by conv_id order by j) as i from edits),
there as (select *, row_number() over (partition by conv_id order by j) as e from walked where edit <> 'D'),
given as (
  select t.conv_id, t.j, t.e, t.edit, f.role, case when t.edit = 'I' then '' else f.text end as text,
    max(case when t.e = 1 and t.edit = 'K' and left(f.role, 1) = 's' then 1 else 0 end) over (partition by t.conv_id) as lead_in
  from there t left join f on f.conv_id is not distinct from t.conv_id and f.i = t.i),
joined as (
  select conv_id, sha256(string_agg(
    case when edit = 'K' then role when (e - lead_in) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by j)) as repaired_sha256
  from given group by conv_id),
faults as (
  select conv_id, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end as gaps,
    count(*) filter (where fault = 2) as blank, count(*) filter (where fault = 3) as duplicate, count(*) filter (where fault = 1) as truncated,
    count(*) filter (where i < n and left(role, 1) || left(following, 1) not in ('su', 'ua', 'au')) as illegal
  from f group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
  coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join faults on faults.conv_id is not distinct from c.conv_id
left join solved on solved.conv_id is not distinct from c.conv_id
left join joined on joined.conv_id is not distinct from c.conv_id"""

ORACLES = {
    "op3_url_filter": _OP3,
    "op6_mix_sources": _OP6,
    "op11_divergence": _OP11,
    "op13_repair_conversations": _OP13,
}
