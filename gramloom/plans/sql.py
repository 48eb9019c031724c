"""DuckDB SQL for the grammar queries: the parse as a recursive query over windows, and everything else on top."""

from __future__ import annotations

CONVERSATIONS = "select row_number() over (order by conv_id, turn) - 1 as id, text from conversations"


def _cut(source: str, part: str, where: str) -> str:
    """Symbols with a 1 where a phrase begins inside a string."""
    return f"""select id, lvl, pos, fp, case when (pf is null or pf <> fp) and pf > fp and rf > fp then 1 else 0 end as cut from (
      select id, lvl, pos, fp, pf, first_value(case when nf <> fp then nf end ignore nulls) over (partition by {part} order by pos rows between current row and unbounded following) as rf
      from (select id, lvl, pos, fp, lag(fp) over w as pf, lead(fp) over w as nf from {source} where {where} window w as (partition by {part} order by pos)))"""


def base(strings: str = CONVERSATIONS, hexed: str = "hex(encode(text))") -> str:
    """CTEs: strs, b0, lv (symbols of every round), ph, occ (phrases), rules, sym, rhs, roots, el (expansion lengths)."""
    return f"""with recursive strs as (select id, {hexed} as h from ({strings}) where length({hexed}) > 0),
b0 as (select id, p as pos, substr(h, (2 * p - 1)::int, 2) as s from (select id, h, unnest(range(1, length(h) // 2 + 1)) as p from strs)),
lv(id, lvl, pos, fp, n) as (
  select id, 0, pos, md5(s), count(*) over (partition by id) from b0
  union all
  select id, lvl + 1, row_number() over (partition by id order by ph), fp, count(*) over (partition by id)
  from (select id, lvl, ph, md5(string_agg(fp, '' order by pos)) as fp from (
    select id, lvl, pos, fp, sum(cut) over (partition by id order by pos rows unbounded preceding) as ph from ({_cut('lv', 'id', 'n > 1 or lvl = 0')})) group by id, lvl, ph)),
ph as (select id, lvl, pos, fp, sum(cut) over (partition by id, lvl order by pos rows unbounded preceding) as ph from ({_cut('lv', 'id, lvl', 'n > 1 or lvl = 0')})),
occ as (select id, lvl + 1 as lvl, row_number() over (partition by id, lvl order by ph) - 1 as pos, fp, kids, start, size from (
  select id, lvl, ph, md5(string_agg(fp, '' order by pos)) as fp, list(fp order by pos) as kids, min(pos) - 1 as start, count(*) as size from ph group by id, lvl, ph)),
rules as (select lvl, fp, any_value(kids) as kids from occ group by lvl, fp),
sym as (select i as sym_id, 't' as kind, 0 as lvl, md5(printf('%02X', i)) as fp, i as byte from range(256) t(i)
  union all select 255 + row_number() over (order by lvl, fp), 'lc', lvl, fp, null from rules),
rhs as (select s.sym_id as owner, k.pos, c.sym_id as child from (select lvl, fp, unnest(kids) as kf, unnest(range(0, len(kids))) as pos from rules) k
  join sym s on s.lvl = k.lvl and s.fp = k.fp join sym c on c.lvl = k.lvl - 1 and c.fp = k.kf),
roots as (select lv.id as str_id, sym_id as child, lv.lvl, lv.fp from lv join sym on sym.lvl = lv.lvl and sym.fp = lv.fp where n = 1 and lv.lvl > 0),
el(sym_id, len) as (select i, 1::hugeint from range(256) t(i) union all select owner, sum(len) from rhs join el on child = sym_id group by owner)"""


RL = """,
runs as (select owner, min(pos) as pos, child, count(*) as run_len from (select owner, pos, child, pos - row_number() over (partition by owner, child order by pos) as island from rhs) group by owner, child, island),
rl as (select (select max(sym_id) from sym) + row_number() over (order by child, run_len) as sym_id, child, run_len from (select distinct child, run_len from runs where run_len > 1)),
rhs2 as (select owner, row_number() over (partition by owner order by pos) - 1 as pos, coalesce(rl.sym_id, runs.child) as child from runs left join rl on rl.child = runs.child and rl.run_len = runs.run_len),
sym2 as (select sym_id, kind, lvl, byte from sym union all select sym_id, 'rl', null, null from rl),
freq as (select sym_id, kind, coalesce(f, 0)::bigint as freq from sym2 left join (select child, sum(k) as f from (select child, 1 as k from rhs2 union all select child, 1 from roots union all select child, 2 from rl) group by child) on child = sym_id),
gone as (select sym_id, kind, freq from freq where freq = 0 or (freq = 1 and kind = 'lc')),
el2 as (select sym_id, len from el union all select rl.sym_id, len * run_len from rl join el on el.sym_id = rl.child)"""

SIMPLE = RL + """,
kept as (select sym_id, kind, byte, row_number() over (order by sym_id) - 1 as new_id from sym2 anti join gone using (sym_id)),
inl(owner, path, child) as (
  select 'r' || owner, [pos], child from rhs2 semi join kept on kept.sym_id = owner
  union all select 's' || str_id, [0], child from roots
  union all select i.owner, list_append(i.path, c.pos), c.child from inl i join gone on gone.sym_id = i.child join rhs2 c on c.owner = i.child),
body as (select owner, row_number() over (partition by owner order by path) - 1 as pos, child from inl anti join gone on gone.sym_id = inl.child),
bodyid as (select owner, pos, new_id as child from body join kept on kept.sym_id = body.child)"""


def half(k: int) -> str:
    return f"select id, text from ({CONVERSATIONS}) where id % 2 = {k}"


def two() -> str:
    """Rules of both halves: a and b (lvl, fp)."""
    first, second = (base(half(k)) + " select distinct lvl, fp from rules" for k in (0, 1))
    return f"with a as ({first}), b as ({second})"


EDITED = f"""select id, substr(h, 1, 2 * (n // 4)::int) || substr(h, 2 * (n // 2 + 1)::int + 1) as h from (select id, h, length(h) // 2 as n from (select id, hex(encode(text)) as h from ({CONVERSATIONS})))"""



def _sizes(counts: str) -> str:
    width = lambda c: f"length(bin({c}))"
    return f"""select *, round(n / ((r * {width('g')} + 7) // 8 + (g * {width('r')} + 7) // 8 + (s + 1) * 8), 4) as ratio from ({counts})"""


N = "(select sum(length(h) // 2 + 1) from strs)::bigint"
PLAIN = _sizes(f"select {N} as n, (select count(*) from sym) + 1 as r, (256 + (select count(*) from rhs) + (select count(*) from roots))::bigint as g, (select count(*) from roots) as c, (select count(*) from strs) as s, 256::bigint as n_terminals, (select count(*) from rules) as n_lc, 0::bigint as n_rl")
SIMPLE_SIZES = _sizes(f"""select {N} as n, (select count(*) from kept) + 1 as r, ((select count(*) from kept where kind = 't') + (select count(*) from body) + 2 * (select count(*) from rl))::bigint as g,
  (select count(*) from body where owner[1] = 's') as c, (select count(*) from strs) as s, (select count(*) from kept where kind = 't') as n_terminals, (select count(*) from kept where kind = 'lc') as n_lc, (select count(*) from rl) as n_rl""")

_BITS = "case when v = 0 then 0 else length(bin(v)) end"
_VALUES = "select distinct (o_orderkey * o_custkey)::bigint as v from orders union select unnest([0, 1, 2, 127, 128, 255, 256, 16383, 16384, 1073741824])::bigint"
_VB = "greatest(1, (length(bin(v)) + 6) // 7)"
_QUERIES = f"select id, length(h) // 2 as n, h, length(h) // 8 as a, length(h) // 8 + 9 + id % 40 as b from (select id, hex(encode(text)) as h from ({CONVERSATIONS}))"

B = base()
ORACLES: dict[str, str] = {
    "scan_strings": f"select id as str_id, strlen(text)::bigint as n_bytes, md5(text) as digest from ({CONVERSATIONS})",
    "collection_stats": f"select count(*) as n_strings, sum(strlen(text) + 1)::bigint as n_bytes, (max(strlen(text)) + 1)::bigint as longest, (min(strlen(text)) + 1)::bigint as shortest, count(*) filter (strlen(coalesce(text, '')) = 0) as n_empty, any_value(alphabet) as alphabet, any_value(least_byte) as least_byte, any_value(greatest_byte) as greatest_byte, any_value(n_separators) as n_separators from ({CONVERSATIONS}), (select count(distinct v) as alphabet, min(v) as least_byte, max(v) as greatest_byte, count(*) filter (v = 10) as n_separators from (select ('0x' || substr(h, (2 * p - 1)::int, 2))::int as v from (select h, unnest(range(1, length(h) // 2 + 1)) as p from (select hex(encode(text)) as h from ({CONVERSATIONS})))))",
    "byte_histogram": "select ('0x' || s)::int as byte, count(*) as n from (select substr(h, (2 * p - 1)::int, 2) as s from (select h, unnest(range(1, length(h) // 2 + 1)) as p from (select hex(encode(text)) as h from documents))) group by s",
    "string_offsets": f"select id as str_id, (sum(strlen(text) + 1) over (order by id) - strlen(text) - 1)::bigint as start, (strlen(text) + 1)::bigint as size from ({CONVERSATIONS})",
    "byte_fingerprints": "select i as byte, md5(printf('%02X', i)) as fp from range(256) t(i)",
    "symbol_runs": f"""{B} select id as str_id, row_number() over (partition by id order by min(pos)) - 1 as run, ('0x' || s)::int as byte, count(*) as size
from (select id, pos, s, pos - row_number() over (partition by id, s order by pos) as island from b0) group by id, s, island""",
    "parse_round1": f"{B} select id as str_id, pos, fp, start, size from occ where lvl = 1",
    "parse_round2": f"{B} select id as str_id, pos, fp, start, size from occ where lvl = 2",
    "parse_all_levels": f"{B} select id as str_id, lvl, pos, fp from occ",
    "level_rules": f"{B} select lvl, fp, array_to_string(kids, '') as rhs from rules",
    "rules_per_level": f"{B} select lvl, count(*) as n_rules, sum(len(kids))::bigint as n_symbols from rules group by lvl",
    "string_heights": f"{B} select str_id, lvl as height, fp from roots",
    "phrase_counts": f"{B} select lvl, fp, count(*) as n from occ group by lvl, fp",
    "assign_ids": f"{B} select sym_id, kind, lvl, fp from sym",
    "symbol_freq": f"{B} select sym_id, coalesce(f, 0)::bigint as freq from sym left join (select child, count(*) as f from (select child from rhs union all select child from roots) group by child) on child = sym_id",
    "symbol_kinds": f"{B}{RL} select kind, count(*) as n from sym2 group by kind",
    "symbol_level": f"{B} select sym_id, lvl from sym",
    "rule_lengths": f"{B} select owner as sym_id, count(*) as n_children from rhs group by owner",
    "rhs_ends": f"{B} select owner as sym_id, list(child order by pos)[1:2] as prefix, list_reverse(list(child order by pos)[-2:]) as suffix from rhs group by owner",
    "grammar_stats": f"{B} {PLAIN}",
    "strings_in_order": f"{B} select str_id, child as sym_id from roots",
    "expansion_length": f"{B}{RL} select sym_id, len::bigint as len from el2",
    "expand_symbol": f"""{B}, ex(sym_id, h) as (select i, printf('%02X', i) from range(256) t(i) union all select owner, string_agg(h, '' order by pos) from rhs join ex on child = sym_id group by owner) select sym_id, h as hex from ex""",
    "decompress": f"select id as str_id, hex(encode(text)) as hex from ({CONVERSATIONS})",
    "verify_roundtrip": f"select count(*) as n_strings, count(*) as n_equal, sum(strlen(text))::bigint as n_bytes from ({CONVERSATIONS})",
    "parse_tree": f"""{B}, st as (select owner, pos, child, (sum(len) over (partition by owner order by pos) - len)::bigint as off from rhs join el on child = sym_id),
tree(str_id, depth, pos, sym_id, start) as (select str_id, 1, 0::bigint, child, 0::bigint from roots union all select str_id, depth + 1, st.pos, st.child, start + off from tree join st on owner = sym_id)
select str_id, depth, pos, sym_id, start from tree""",
    "ra_samples_rules": f"""{B}{RL}, e as (select owner, pos, sum(len) over (partition by owner order by pos) as acc, count(*) over (partition by owner) as n from rhs2 join el2 on child = el2.sym_id)
select owner as sym_id, (pos + 1)::bigint as pos, acc::bigint as acc from e where (pos + 1) % 4 = 0 or pos + 1 = n union all select rl.sym_id, run_len, len::bigint from rl join el2 on el2.sym_id = rl.sym_id""",
    "ra_samples_strings": f"""{B}{SIMPLE} select owner[2:]::bigint as str_id, (pos + 1)::bigint as pos, acc::bigint as acc from (
  select owner, pos, sum(len) over (partition by owner order by pos) as acc from body join el2 on el2.sym_id = child where owner[1] = 's') where (pos + 1) % 8 = 0""",
    "access_char": f"select id as qid, substr(h, 2 * (a + 1)::int - 1, 2) as hex from ({_QUERIES}) where a < n",
    "access_range": f"select id as qid, substr(h, 2 * a::int + 1, 2 * (b - a + 1)::int) as hex from ({_QUERIES}) where a < n",
    "parse_coords": f"""select q as query, case when ok then regexp_extract(q, '^(\\d+):', 1)::bigint end as str_id, case when ok then regexp_extract(q, ':(\\d+)-', 1)::bigint end as start, case when ok then regexp_extract(q, '-(\\d+)$', 1)::bigint end as stop
from (select q, regexp_matches(q, '^\\d+:\\d+-\\d+$') as ok from (select case when id % 7 = 3 then id || ':' || a when id % 7 = 5 then 'x:' || a || '-' || b else id || ':' || a || '-' || b end as q from ({_QUERIES})))""",
    "rl_runs": f"{B}{RL} select owner, pos, child, run_len from runs where run_len > 1",
    "rl_rules": f"{B}{RL} select sym_id, child, run_len from rl",
    "rl_rewrite": f"{B}{RL} select owner, pos, child from rhs2",
    "rhs_unrolled": f"{B} select owner, pos, child from rhs",
    "disposable_symbols": f"{B}{RL} select sym_id, kind, freq from gone",
    "id_compaction": f"{B}{SIMPLE} select sym_id, new_id from kept",
    "simplified_rules": f"{B}{SIMPLE} select k.new_id as owner, pos, b.child from bodyid b join kept k on b.owner = 'r' || k.sym_id",
    "simplified_stats": f"{B}{SIMPLE} {SIMPLE_SIZES}",
    "string_rhs_len": f"{B}{SIMPLE} select owner[2:]::bigint as str_id, count(*) as n from body where owner[1] = 's' group by owner",
    "string_boundaries": f"""{B}{SIMPLE} select str_id, (sum(n) over (order by str_id) - n)::bigint as start, n as size from (select owner[2:]::bigint as str_id, count(*) as n from body where owner[1] = 's' group by owner)""",
    "alphabet_remap": f"{B}{SIMPLE} select new_id, byte from kept where kind = 't'",
    "known_rules": f"{two()} select lvl, fp from b semi join a using (lvl, fp)",
    "new_rules": f"{two()} select lvl, fp from b anti join a using (lvl, fp)",
    "merge_marks": f"{two()} select lvl, mark, count(*) as n from (select lvl, fp, sum(m)::int as mark from (select lvl, fp, 1 as m from a union all select lvl, fp, 2 from b) group by lvl, fp) group by lvl, mark",
    "merge_grammars": f"{B} select lvl, fp, array_to_string(kids, '') as rhs from rules",
    "merge_strings": f"{B} select str_id, lvl, fp from roots",
    "incremental_build": f"{B} select lvl, count(*) as n_rules, sum(len(kids))::bigint as n_symbols from rules group by lvl",
    "fp_placement": f"{two()} select lvl, fp, place from (select lvl, fp, old, (sum(old) over (partition by lvl order by fp) - old)::bigint as place from (select lvl, fp, 1 as old from a union all select lvl, fp, 0 from (select * from b anti join a using (lvl, fp)))) where old = 0",
    "bit_widths": f"""select v, {_BITS} as width, (1::bigint << ({_BITS})) as next_power, case when v > 0 then (1::bigint << ({_BITS} - 1)) end as prev_power, (v & (v - 1)) = 0 as is_power, case when (v & (v - 1)) = 0 then v else (1::bigint << ({_BITS})) end as rounded from ({_VALUES})""",
    "vbyte_size": f"{B} select lvl, sum({_VB.replace('v)', 'n)')})::bigint as n_bytes from (select lvl, fp, count(*) as n from occ group by lvl, fp) group by lvl",
    "vbyte_roundtrip": f"""select v, {_VB} as n_bytes, array_to_string(list_transform(range(0, {_VB}), lambda i: printf('%02X', ((v >> (7 * i)::int) & 127) + case when i = {_VB} - 1 then 128 else 0 end)), '') as forward,
  array_to_string(list_transform(range(0, {_VB}), lambda i: printf('%02X', ((v >> (7 * i)::int) & 127) + case when i = 0 then 128 else 0 end)), '') as backward, v as decoded, v as decoded_back from ({_VALUES})""",
    "h0_entropy": f"""{B}{RL} select t::bigint as total, round(h, 6) as h0, round(t * h, 2) as nh0 from (select any_value(t) as t, sum(freq / t * log2(t / freq)) as h from (select freq, sum(freq) over () as t from freq where freq > 0))""",
    "code_sizes": f"""{B}{RL}, k as (select freq, row_number() over (order by sym_id) as i, row_number() over (order by freq desc, sym_id) as j from freq)
select sum(((length(bin(i)) + 7) // 8 + length(bin(i)) + 7) // 8 * freq)::bigint as by_id, sum(((length(bin(j)) + 7) // 8 + length(bin(j)) + 7) // 8 * freq)::bigint as by_frequency from k""",
    "report_space": "select v, case when v < 1000 then v || ' bytes' else (c // 100) || '.' || printf('%02d', c % 100) || ' ' || unit end as space from (select v, u, unit, (v + u // 200) // greatest(1, u // 100) as c from ("
    + "select v, case when v < 1000 then 1 when v < 1000000 then 1000 when v < 1000000000 then 1000000 when v < 1000000000000 then 1000000000 else 1000000000000 end as u, "
    + f"case when v < 1000000 then 'KB' when v < 1000000000 then 'MB' when v < 1000000000000 then 'GB' else 'TB' end as unit from ({_VALUES})))",
    "report_rates": """select v, printf('%.2f', (case when v >= 1073741824 then v / 1073741824 when v >= 1048576 then v / 1048576 when v >= 1024 then v / 1024 else v end) / 250) || case when v >= 1073741824 then ' GB' when v >= 1048576 then ' MB' when v >= 1024 then ' KB' else ' B' end || '/ms' as speed,
  case when v >= 3600000 then lpad((v // 3600000)::varchar, greatest(2, length((v // 3600000)::varchar))::int, '0') || ':' || printf('%02d', v // 60000 % 60) || ':' || printf('%02d', v // 1000 % 60) || '.' || v % 1000
    when v >= 60000 then printf('%02d', v // 60000 % 60) || ':' || printf('%02d', v // 1000 % 60) || '.' || v % 1000 when v >= 1000 then v // 1000 % 60 || '.' || v % 1000 else (v % 1000)::varchar end as elapsed
  from (select distinct o_orderkey * 977 % 90000000 as v from orders)""",
    "delete_range": f"{base(EDITED, 'h')} select str_id, lvl, fp from roots",
    "delete_range_stats": f"{base(EDITED, 'h')} select lvl, count(*) as n_rules, sum(len(kids))::bigint as n_symbols from rules group by lvl",
    "lcp_pairs": f"""with t as (select id, hex(encode(text)) as h from ({CONVERSATIONS})), p as (select x.id as a, y.id as b, x.h as x, y.h as y from t x join t y on y.id = x.id + 2),
k as (select a, k from (select a, x, y, unnest(range(1, (least(length(x), length(y)) // 2 + 1)::bigint)) as k from p) where substr(x, 1, (2 * k)::int) = substr(y, 1, (2 * k)::int))
select p.a, p.b, coalesce(m, 0)::bigint as lcp, case when x < y then -1 when x = y then 0 else 1 end as cmp from p left join (select a, max(k) as m from k group by a) k on k.a = p.a""",
    "grammar_meta": f"{B}{SIMPLE} select *, true as has_rl, true as simplified, false as has_ra from ({SIMPLE_SIZES})",
    "stored_rules": f"{B} select lvl, count(*) as n_rules, sum(len(kids))::bigint as n_symbols from rules group by lvl",
}
