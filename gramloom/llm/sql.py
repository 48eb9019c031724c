"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from gramloom.llm import chat, mixing, secrets, warc
from gramloom.llm.common import LOWER, UPPER


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op1() -> str:
    t = f"regexp_replace(html, {quote(warc.HIDDEN)}, ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)</?(?:{warc.BLOCK_TAGS})\\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '</?[A-Za-z][^>]*>|<[!?][^>]*>', '', 'g')"
    for name, char in warc.ENTITIES.items():  # the ampersand's own last
        t = f"replace({t}, {quote(f'&{name};')}, {quote(char)})"
    t = f"regexp_replace({t}, '[ \\t\\f\\r]{{2,}}|[\\t\\f\\r]', ' ', 'g')"
    t = f"trim(regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
    return f"""
with macro_free as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages
), blocks as (
  select *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) as head from macro_free
), ids as (
  select *, {_b32("sha1(html)")} as payload, {_b32("sha1(head || chr(13) || chr(10) || chr(13) || chr(10) || html)")} as block from blocks
), named as (
  select *, {_urn("'response|' || url || '|' || block")} as rid from ids
), linked as (
  select *, {_urn("'metadata|' || rid")} as mid, {_urn("'conversion|' || rid")} as cid from named
), made as (
  select page_id, 'metadata' as warc_type, mid as record_id, rid as refers_to, url as target_uri, 'application/warc-fields' as content_type,
    concat_ws(chr(13) || chr(10), 'http-status: 200', 'source-header: Content-Type: text/html; charset=utf-8', 'source-header: Content-Length: ' || strlen(html),
      'source-payload-digest: ' || payload, 'source-block-digest: ' || block, 'conversion: ' || cid,
      'title: ' || trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g'))) || chr(13) || chr(10)
      || array_to_string(list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1), lambda u: 'outlink: ' || u || chr(13) || chr(10)), '') as body from linked
  union all
  select page_id, 'conversion', cid, rid, url, 'text/plain; charset=utf-8', {t} from linked
)
select page_id, warc_type, record_id, refers_to, target_uri, content_type, {_b32("sha1(body)")} as block_digest, strlen(body)::bigint as content_length from made"""


def _b32(hexed: str) -> str:
    return f"""('sha1:' || array_to_string(list_transform(range(0, 32), lambda j: substr('{warc.BASE32}', 1 + ((('0x' || substr({hexed}, (5 * (j // 4) + 1)::int, 5))::bigint >> (15 - 5 * (j % 4))::int) & 31)::int, 1)), ''))"""


def _urn(named: str) -> str:
    return f"regexp_replace(md5({named}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.*)$', '<urn:uuid:\\1-\\2-\\3-\\4-\\5>')"


def _op3() -> str:
    words = lambda c: f"list_filter(string_split_regex(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
with d as (select row_number() over () as u, doc_id, {words('text')} as w from documents),
i as (select coalesce(item_id::varchar, '') as item, {words('text')} as w from benchmark),
iw as (select distinct item, n, array_to_string(w[p:p + n - 1], ' ') as g
       from (select *, unnest(range(1, len(w) - n + 2)) as p from (select *, least(10, len(w)) as n from i where len(w) > 0))),
l as (select distinct n from iw),
dw as (select u, n, p, array_to_string(w[p:p + n - 1], ' ') as g from (select u, w, n, unnest(range(1, len(w) - n + 2)) as p from d, l where len(w) >= n)),
h as (select u, item, p, dw.n from dw join iw on dw.n = iw.n and dw.g = iw.g),
c as (select u, count(distinct q) as n_hit from (select u, unnest(range(p, p + n)) as q from (select distinct u, p, n from h)) group by u),
s as (select u, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct u, item from h) group by u)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (u) left join s using (u)"""


def _op4() -> str:
    return r"""
with d as (select row_number() over () as u, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select u, p, md5(array_to_string(w[p:p + 34], ' ')) as h from (select u, w, unnest(range(1, len(w) - 33)) as p from d where len(w) >= 35)),
r as (select u, p from s where h in (select h from s group by h having count(*) > 1)),
gone as (select distinct u, unnest(range(p, p + 35)) as q from r),
kept as (select u, string_agg(x, ' ' order by q) as t, count(*) as n from (select u, unnest(w) as x, unnest(range(1, len(w) + 1)) as q from d) a anti join gone using (u, q) group by u)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (u)"""


def _op5() -> str:
    esc = lambda c: f"regexp_replace({c}, '{chat.HEAD}(\\\\*){chat.CONTROL}', '\\1\\\\\\2\\3', 'g')"
    marks = len(chat.START) + len(chat.SEP) + len(chat.END)
    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, i, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(i, r))
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length({esc('role')}) + length({esc('text')}) + {marks})::bigint as formatted_chars
from t group by conv_id"""


def _op6() -> str:
    seed = 7
    return f"""
with d as (
  select row_number() over () as u, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5(concat_ws('|', doc_id::varchar, text)) as k from documents
), b as (select *, (('0x' || substr(md5(k || '|{seed}'), 1, 8))::bigint % {mixing.BLOCKS})::int as block from d),
s as (select source, sum(size)::bigint as size from d group by source),
w as (select *, [{', '.join(map(str, mixing.WEIGHTS))}][(row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1] as weight, size * {float(mixing.CAP)}::double as cap from s),
o as (select *, row_number() over x as nth, coalesce(sum(cap) over (x rows between unbounded preceding and 1 preceding), 0) as done, coalesce(sum(weight) over (x rows between unbounded preceding and 1 preceding), 0) as dw,
        sum(size) over () as words, sum(weight) over () as weights from w window x as (order by cap / weight, source nulls last)),
v as (select *, ({mixing.SHARE}::double * words - done) / (weights - dw) as level from o),
f as (select source, size, coalesce(least(cap, (select first(level order by nth) from v where level <= cap / weight) * weight), cap)::double as target from v),
filled as (select source, block, sum(size)::bigint as words from b group by all having sum(size) > 0),
laid as (select l.*, f.target, floor(f.target)::bigint as quota, sum(words) over (partition by l.source order by epoch, md5(concat_ws('|', l.source, epoch::varchar, block::varchar, '{seed}')), block rows unbounded preceding) - words as start
         from (select *, unnest(range(0, {int(-(-mixing.CAP // 1))})) as epoch from filled) l join f on l.source is not distinct from f.source),
drawn as (select source, block, epoch, least(words, quota - start) as take, start + words > quota as last from laid where start < quota),
got as (select u, size, take, last, sum(size) over (partition by b.source, b.block, epoch order by md5(concat_ws('|', k, epoch::varchar, '{seed}')), u rows unbounded preceding) - size as start
        from b join drawn on b.source is not distinct from drawn.source and b.block = drawn.block where size > 0),
t as (select u, sum(case when last then greatest(0, least(size, take - start)) else size end)::bigint as taken from got group by u)
select doc_id, d.size, f.size as source_size, f.target, coalesce(taken, 0)::bigint as taken from d join f on d.source is not distinct from f.source left join t using (u)"""


def _op8() -> str:
    parts = "[" + ", ".join(map(quote, secrets.PARTS)) + "]"
    cap = lambda c: f"upper({c}[1]) || {c}[2:]"
    part = lambda k: f"{parts}[i * {k} % {len(secrets.PARTS)} + 1]"
    date = "printf('%d-%02d-%02d', 1970 + i % 80, 1 + i * 7 % 12, 1 + i * 11 % 28)"

    def spans(kind: str, ord_: int, pattern: str, group: int, least: int) -> str:
        p = quote(pattern)
        return f"""select u, '{kind}' as kind, {ord_} as ord, s - length(m) as start, s as stop, m as value from (
          select u, m, n, sum(length(g) + length(m)) over (partition by u order by i) as s from (
            select u, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m, unnest(gs[1:len(ms)]) as g, unnest(ns) as n from (
              select u, ms, string_split_regex(text, {p}) as gs, list_transform(regexp_extract_all(text, {p}, {group}), lambda x: length(x)) as ns
              from (select u, text, regexp_extract_all(text, {p}) as ms from d) where len(ms) > 0))) where n >= {least}"""

    base = " union all ".join(spans(k, i, *v) for i, (k, v) in enumerate(secrets.PATTERNS.items()))
    return f"""
with random as (select unnest([h, x, translate(x, '+/=', '-_'), substr(upper(translate(y, '+/=', '')), 1, 40)]) as v from (
    select h, to_base64(from_hex(h)) as x, to_base64(from_hex(sha256(h))) as y from (select sha256('sample' || i) as h from range({secrets.N_RANDOM}) r(i)))),
plain as (select unnest([a || '_' || b, a || {cap('b')}, {cap('a')} || {cap('b')}, a || '-' || b, a || b, upper(a || '_' || b), a || '/' || b]) as v
    from (select unnest({parts}) as a) x, (select unnest({parts}) as b) y
  union all select unnest([{date} || '/' || printf('%d-%02d-%02d', 1970 + i % 80, 1 + i * 5 % 12, 1 + i * 3 % 28), {part(1)} || '-' || {date}, printf('%d/%02d/%02d/', 1970 + i % 80, 1 + i * 7 % 12, 1 + i * 11 % 28) || {part(3)},
    {part(7)} || '_' || (i * 37 % 1000), {date} || printf('T%02d-%02d-00', i * 5 % 24, i * 13 % 60), {part(5)} || (i % 100), (100000000000 + i * 829348951)::varchar]) from range({secrets.N_PLAIN}) r(i)
  union all select unnest([{', '.join(map(quote, secrets.RULERS))}]) from range({secrets.N_RULERS})),
pairs as (select label, ord(v[i]) as x, ord(v[i + 1]) as y, count(*) as n from (select label, v, unnest(range(1, length(v))) as i from (select 1 as label, v from random union all select 0, v from plain)) group by all),
sums as (select label, x, sum(n) as n from pairs group by all),
grid as (select a.i as x, b.i as y from range(128) a(i), range(128) b(i)),
model as (select grid.x, grid.y, round(1000 * ln(((coalesce(p1.n, 0) + 1) / (coalesce(s1.n, 0) + 66)) / ((coalesce(p0.n, 0) + 1) / (coalesce(s0.n, 0) + 66))))::bigint as score from grid
    left join pairs p1 on p1.label = 1 and p1.x = grid.x and p1.y = grid.y left join pairs p0 on p0.label = 0 and p0.x = grid.x and p0.y = grid.y
    left join sums s1 on s1.label = 1 and s1.x = grid.x left join sums s0 on s0.label = 0 and s0.x = grid.x),
d as (select row_number() over () as u, doc_id, coalesce(text, '') as text from documents),
base as ({base}),
cand as ({spans('markov', len(secrets.PATTERNS), secrets.CANDIDATE, 0, 0)}),
scored as (select u, start, stop, value, sum(score) as ratio
    from (select *, unnest(range(1, length(value))) as i from cand) c join model on x = ord(value[i]) and y = ord(value[i + 1]) group by u, start, stop, value),
alls as (select u, kind, ord, start, stop from base union all
    select u, 'markov', {len(secrets.PATTERNS)}, start, stop from scored where ratio >= {secrets.THRESHOLD} and not exists (select 1 from base where base.u = scored.u and base.start <= scored.start and base.stop >= scored.stop)),
g as (select u, {', '.join(f"count(*) filter (kind = '{k}') as n_{k}" for k in secrets.PATTERNS)},
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (kind <> 'markov') as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) as spans from alls group by u)
select doc_id, {', '.join(f'coalesce(n_{k}, 0)::bigint as n_{k}' for k in secrets.PATTERNS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (u)"""


ORACLES: dict[str, str] = {
    "op1_warc_derivatives": _op1(),
    "op3_benchmark_decontamination": _op3(),
    "op4_substring_dedup": _op4(),
    "op5_chat_formatting": _op5(),
    "op6_source_mixing": _op6(),
    "op8_secret_scan": _op8(),
}
