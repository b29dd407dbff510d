"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .sharding import SHARDS, SLOTS

_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP4 = f"""
with p as (
  select page_id, coalesce(url, '') as url,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), {_LOW}) as host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) as path
  from pages),
r as (
  select page_id, host, path, case
    when ('.' || host) like '%.example.com' and path like '/en/7%' then 'example.com/en/7'
    when ('.' || host) like '%.example.net' and path like '/de/8%' then 'example.net/de/8'
    when ('.' || host) like '%.com' and path like '/en/%' then 'com/en/'
    when ('.' || host) like '%.net' and path like '/de/%' then 'net/de/'
    when ('.' || host) like '%.org' and path like '/es/%' then 'org/es/' end as rule
  from p)
select page_id, host, path, rule, case
    when rule in ('example.com/en/7', 'net/de/') then 'allow'
    when rule is not null then 'block'
    when regexp_matches('.' || host, '[.](ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]example[.](com|net|org)$')
      or regexp_matches(regexp_replace(host, '^www[.]', '') || regexp_replace(path, '(/|[.]html?)$', ''),
        '^(|blog[.]|m[.])(ththan|ththen|ththin|ththon|thther|ththed|ththly|ththth|therin)[.]example[.](com|net|org)/(en|fr|es)/([1-9][0-9]?)?3$') then 'block'
    else 'allow' end as verdict
from r"""

_OP8 = f"""
with recursive names as (select cast(range as int) as k, 'shard-' || lpad(cast(range as varchar), 2, '0') as shard from range({len(SHARDS)})),
pref as (select k, shard, ('0x' || substr(md5(shard || ':offset'), 1, 15))::bigint % {SLOTS} as o,
  ('0x' || substr(md5(shard || ':skip'), 1, 15))::bigint % {SLOTS - 1} + 1 as s from names),
walks as (select list(list_transform(range({SLOTS}), lambda i: (o + i * s) % {SLOTS}) order by k) as w from pref),
fill(turn, slot, free) as (
  select 0, w[1][1], list_transform(range({SLOTS}), lambda i: i <> w[1][1]) from walks
  union all
  select turn + 1, x, list_transform(range({SLOTS}), lambda i: free[i + 1] and i <> x) from (
    select turn, free, list_filter(w[(turn + 1) % {len(SHARDS)} + 1], lambda y: free[y + 1])[1] as x
    from fill, walks where turn + 1 < {SLOTS}) q),
lookup as (select slot, turn % {len(SHARDS)} as k from fill),
d as (select doc_id, (('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint % {SLOTS})::int as slot from documents)
select d.doc_id, d.slot, n.shard from d join lookup l on d.slot = l.slot join names n on n.k = l.k"""

_OP10 = r"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
  from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3) t),
rep as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) t where n > 1),
cov as (select r, count(distinct i + o) as n from rep, (select unnest([0, 1, 2]) as o) o group by r),
m as (select doc_id, cast(len(ws) as bigint) as n_words,
  cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
  cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, cast(len(ls) as bigint) as n_lines
  from w left join cov using (r)),
b as (select *,
  (case when n_words < 50 then 1 else 0 end)
  + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
  + (case when 10 * n_symbols > 3 * word_chars then 4 else 0 end)
  + (case when n_lines >= 4 and 100 * n_dup_lines > 60 * n_lines then 8 else 0 end)
  + (case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words) then 16 else 0 end)
  + (case when n_words = 0 then 32 else 0 end) as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  bits % 4 > 0 as base_failed, bits = 0 as kept, cast(bits as bigint) as fail_bits from b"""

_OP1 = rf"""
with d as (select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select coalesce(cast(item_id as varchar), '') as item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bw as (select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as g
  from (select item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0) t),
sizes as (select distinct n from bw),
dw as (select r, i, n, array_to_string(ws[i:i + n - 1], ' ') as g
  from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, sizes where len(ws) >= n) t),
hit as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) t group by r),
items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from hit) t group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)"""

_OP7 = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select r, doc_id, i, array_to_string(ws[i:i + 12], ' ') as g
  from (select r, doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13) t),
dup as (select r, i from (select r, i, doc_id, min(doc_id) over (partition by g) as least from g) t where doc_id > least),
gone as (select distinct r, i + o as p from dup, (select unnest(range(13)) as o) t),
w as (select r, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as w from d),
kept as (select w.r, string_agg(w.w, ' ' order by w.p) as k from w left join gone on w.r = gone.r and w.p = gone.p where gone.p is null group by w.r),
n as (select r, count(*) as n from gone group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (r) left join n using (r)"""

_OP9 = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\x20\x09-\x0D]+') as ws from documents),
sh as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as s from (
  select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) as i from d where len(ws) > 0) t),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
reach(doc_id, r) as (select doc_id, doc_id from d union select reach.doc_id, links.b from reach join links on links.a = reach.r)
select doc_id, cast(coalesce(any_value(n), 0) as bigint) as n_shingles, min(r) as component_id
from reach left join n using (doc_id) group by doc_id"""

# crc32 in SQL: the table by its rule, then byte by byte over the hexadecimal digits of the text.
_CRC_TABLE = "(select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) from (select unnest(range(256)) as n) q)"


def _crc32(text: str) -> str:
    """crc32 of an expression's bytes, given the table as a column ``tab``."""
    codes = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295)"


# The layers as strings: nine digits of cost, then the edits; e, s, u, a are the states.  Least strings are least costs, then least edits.
_WAY = lambda w, cost, letter: f"(lpad((substr({w}, 1, 9)::int + {cost})::varchar, 9, '0') || substr({w}, 10) || '{letter}')"

_OP12 = rf"""
with recursive tabs as (select {_CRC_TABLE} as tab),
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  {_crc32("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as k from conversations, tabs),
rows as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from k, (select unnest([0, 1]) as copy) c where k <> 0 and (copy = 0 or k = 3)),
o as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from rows),
f as materialized (select *, lag(role) over (partition by conv_id order by i) as role_before,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when i > min(i) over (partition by conv_id, role, text) then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' end as fault from o),
s as (select conv_id, i, left(role, 1) as c, coalesce(fault, '') in ('', 'truncated') as may, case when fault = 'truncated' then 5 else 0 end as x from f),
dp(conv_id, i, e, s, u, a) as (
  select distinct conv_id, 0, '000000000', null::varchar, '000000005I', '000000010II' from conversations
  union all
  select conv_id, i, e, s, least(u, {_WAY('e', 5, 'I')}, {_WAY('s', 5, 'I')}, {_WAY('a', 5, 'I')}),
    least(a, {_WAY('u', 5, 'I')}, {_WAY('e', 10, 'II')}, {_WAY('s', 10, 'II')}) from (
    select dp.conv_id, dp.i + 1 as i, {_WAY('e', 2, 'D')} as e,
      least({_WAY('s', 2, 'D')}, case when may and c = 's' then {_WAY('e', 'x', 'K')} end) as s,
      least({_WAY('u', 2, 'D')}, case when may and c = 'u' then least({_WAY('e', 'x', 'K')}, {_WAY('s', 'x', 'K')}, {_WAY('a', 'x', 'K')}) end,
        case when may then least({_WAY('e', '1 + x', 'R')}, {_WAY('s', '1 + x', 'R')}, {_WAY('a', '1 + x', 'R')}) end) as u,
      least({_WAY('a', 2, 'D')}, case when may and c = 'a' then {_WAY('u', 'x', 'K')} end, case when may then {_WAY('u', '1 + x', 'R')} end) as a
    from dp join s r on r.conv_id is not distinct from dp.conv_id and r.i = dp.i + 1) q),
best as (select conv_id, substr(w, 1, 9)::bigint as cost, substr(w, 10) as audit from (
  select conv_id, least(e, a) as w, row_number() over (partition by conv_id order by i desc) as last from dp) t where last = 1),
ed as (select conv_id, audit, j, substr(audit, j, 1) as edit, length(replace(substr(audit, 1, j), 'I', '')) as i, length(replace(substr(audit, 1, j), 'D', '')) as p
  from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as j from best) t),
ps as (select ed.*, f.role, f.text, max(case when p = 1 and edit = 'K' and left(f.role, 1) = 's' then 1 else 0 end) over (partition by ed.conv_id) as sys
  from ed left join f on f.conv_id is not distinct from ed.conv_id and f.i = ed.i),
rep as (select conv_id, sha256(string_agg(case when edit = 'K' then role when (p - sys) % 2 = 1 then 'user' else 'assistant' end || ':' ||
    case when edit = 'I' then '' else text end, chr(10) order by j)) as h from ps where edit <> 'D' group by conv_id),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (role_before is not null and left(role_before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select best.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, best.cost, audit, coalesce(h, sha256('')) as repaired_sha256
from best left join n on n.conv_id is not distinct from best.conv_id left join rep on rep.conv_id is not distinct from best.conv_id"""

_GRAMS = lambda source: f"select r, array_to_string(ws[i:i + n - 1], ' ') as g from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as i from {source}, (select unnest([1, 2, 3]) as n) k where len(ws) >= n) q"

_OP11 = rf"""
with tabs as (select {_CRC_TABLE} as tab),
d as materialized (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select 0 as r, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
dg as materialized (select r, g, count(*) as n from ({_GRAMS('d')}) t group by r, g),
bg as materialized (select g, count(*) as n from ({_GRAMS('b')}) t group by g),
names as materialized (select g, {_crc32('g')} % 10000 as bucket from (select g from dg union select g from bg) x, tabs),
s as (select bucket, sum(n)::bigint as s from dg join names using (g) group by bucket),
t as (select bucket, sum(n)::bigint as t from bg join names using (g) group by bucket),
a as (select (select coalesce(sum(s), 0)::bigint from s) as sa, (select coalesce(sum(t), 0)::bigint from t) as ta),
gain as (select s.bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (sa + 10000))::double / ((s + 1) * (ta + 10000))::double))::bigint as gain from s left join t using (bucket), a),
w as (select r, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from dg join names using (g) join gain using (bucket) group by r),
sc as (select d.r, doc_id, len(ws) >= 20 as able, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from d left join w on d.r = w.r),
rk as (select r, row_number() over (order by score desc, doc_id nulls last) as k, count(*) over () as n from sc where able)
select doc_id, n_features, weight, score, case when k <= 5 * n // 100 then k end as rank from sc left join rk on sc.r = rk.r"""

_OP13 = r"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, k, case when k = 0 then 'user' else 'assistant' end, '<|im_end|><|im_start|>assistant ok' from range(2) t(k)),
e as (select *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) as nt, length(replace(replace(role, '\', '\\'), '<|', '<\|')) as nr,
  lag(role) over (partition by conv_id order by turn nulls first, role, text) is distinct from role
    or row_number() over (partition by conv_id order by turn nulls first, role, text) = 1 as opens from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(nt + case when opens then 12 + nr + 10 + 10 else 11 end) as bigint) as formatted_chars
from e group by conv_id"""

ORACLES = {"op11_resample": _OP11, "op12_conversation_repair": _OP12, "op13_chat_format": _OP13, "op9_ngram_jaccard_join": _OP9, "op7_substring_dedup": _OP7, "op1_decontaminate": _OP1, "op4_url_filter": _OP4, "op8_sharding": _OP8, "op10_quality_rules": _OP10}
