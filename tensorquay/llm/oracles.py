"""DuckDB SQL of queries whose text is long."""

from __future__ import annotations

from .quality_rules import LEAST_FACTOR, LEAST_GROUP, PER, RATIOS

_SPACE = r"\x20\x09-\x0D"


def quality_rules_sql() -> str:
    """The rows of op10_quality_rules: counts, fences of each language and source, verdicts."""
    value = lambda count: f"greatest(({count} + 1) * {PER} // greatest(n_words, 1), 1)"
    ratios = ", ".join(f"struct_pack(col0 := '{name}', col1 := {value(count)})" for name, (count, _) in RATIOS.items())
    raised = " ".join(f"when '{name}' then {'sqrt(factor)' if halves % 2 else '1.0'}{' * factor' * (halves // 2)}" for name, (_, halves) in RATIOS.items())
    fence = ", ".join(f"max(fence) filter (where ratio = '{name}') as f{name[1:]}" for name in RATIOS)
    fits = " and ".join(f"coalesce({value(count)} <= f{name[1:]}, true)" for name, (count, _) in RATIOS.items())

    def quartiles(name: str, keys: str) -> str:
        by = f"{keys}, ratio" if keys else "ratio"
        return f"""{name}_n as (select {by}, low, count(*) as n from sketch group by {by}, low),
{name}_u as (select *, sum(n) over (partition by {by} order by low) as up, sum(n) over (partition by {by}) as total from {name}_n),
{name} as (select {by}, max(total) as total, min(low) filter (where up >= 0.25 * total) as q1, min(low) filter (where up >= 0.75 * total) as q3 from {name}_u group by {by})"""

    return rf"""
with d as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (
  select *, regexp_extract_all(t, '[^{_SPACE}]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) as lines from d),
g as (
  select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from g) where n >= 2),
hit as (
  select rid, count(distinct i + k) as n_repeat_words from twice, (select unnest([0, 1, 2]) as k) group by rid),
c as (
  select w.rid, doc_id, lang, source, len(ws)::bigint as n_words, length(regexp_replace(t, '[{_SPACE}]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
         length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_bangs, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_upper
  from w left join hit on hit.rid = w.rid),
x as (
  select lang, source, r.col0 as ratio, r.col1 as x from (select *, unnest([{ratios}]) as r from c where not (n_words < 50 or 100 * n_repeat_words > 50 * n_words))),
sketch as (
  select lang, source, ratio, case when x < 64 then x else (x >> (length(bin(x)) - 6)) << (length(bin(x)) - 6) end::double as low from x),
{quartiles("own", "lang, source")},
{quartiles("by_lang", "lang")},
{quartiles("every", "")},
p as (
  select o.lang, o.source, o.ratio,
         case when o.total >= {LEAST_GROUP} then o.q1 when l.total >= {LEAST_GROUP} then l.q1 else e.q1 end as q1,
         case when o.total >= {LEAST_GROUP} then o.q3 when l.total >= {LEAST_GROUP} then l.q3 else e.q3 end as q3
  from own o left join by_lang l on l.lang is not distinct from o.lang and l.ratio = o.ratio left join every e on e.ratio = o.ratio),
f as (
  select lang, source, {fence} from (select lang, source, ratio, floor(q3 * (case ratio {raised} end))::bigint as fence from (select *, greatest(q3 / q1, {LEAST_FACTOR}::double) as factor from p)) group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and {fits} as kept, c.lang, c.source, {", ".join("f" + name[1:] for name in RATIOS)}
from c left join f on f.lang is not distinct from c.lang and f.source is not distinct from c.source
"""
