"""DuckDB SQL of the queries whose results SQL can express."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, EDGES, ENDS, SIGNS, Rules

#: Smallest vertex that each vertex of ``links`` (a, b, both ways) reaches; {vertices}: all vertices by ``id``.
REACH = """reach(id, r) as (select id, id from {vertices} union select reach.id, links.b from reach join links on links.a = reach.r),
component as (select id, min(r) as component_id from reach group by id)"""


def quoted(text: bytes) -> str:
    return "'" + text.decode().replace("'", "''") + "'"


def embedding_dedup(cosine: float = 0.93) -> str:
    return f"""with recursive v as (select vec_id as id, label, cast(embedding as double[]) as e from embeddings),
ok as materialized (select id, label, list_transform(e, lambda x: coalesce(x, 0)) as e from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(e, lambda x: x * x)) > 0),
links as (select a.id as a, b.id as b from ok a join ok b on a.label = b.label and a.id <> b.id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {cosine}),
{REACH.format(vertices='v')}
select v.id as vec_id, (select count(*) from links where a = v.id) as n_links, component_id, v.id = component_id as kept from v join component using (id)"""


def minhash(k: int = 4, percent: int = 80) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""with recursive w as (select doc_id as id, {words} as w from documents),
s as (select distinct id, unnest(case when len(w) = 0 then [] when len(w) < {k} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) end) as x from w),
n as (select w.id, count(s.x) as n from w left join s using (id) group by w.id),
common as (select a.id as a, b.id as b, count(*) as c from s a join s b on a.x = b.x and a.id <> b.id group by a.id, b.id),
links as (select a, b from common join n p on p.id = a join n q on q.id = b where 100 * c >= {percent} * (p.n + q.n - c)),
{REACH.format(vertices='n')}
select n.id as doc_id, n as n_shingles, component_id, n.id = component_id as kept from n join component using (id)"""


def quality_rules(rules: Rules = Rules()) -> str:
    """Statistics and the verdict of line-first cleaning, line by line."""
    low = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    edges = " || ".join(f"chr({c})" for c in EDGES)
    phrases = " or ".join(f"contains(low, {quoted(x)}) and (starts_with(low, {quoted(x)}) or ends_with(low, {quoted(x)}) or words <= {2 * len(x.split())})" for x in BOILERPLATE)
    ends = " or ".join(f"ends_with(bare, {quoted(x)})" for x in ENDS)
    signs = "length(line) - length(translate(line, " + quoted(SIGNS) + ", ''))"
    return rf"""with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
u as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d),
g as (select doc_id, i, x, lead(x, 1) over o as y, lead(x, 2) over o as z from u window o as (partition by doc_id order by i)),
r as (select doc_id, i, z is not null and count(*) over (partition by doc_id, x, y, z) > 1 as again from g),
c as (select doc_id, max(again) over (partition by doc_id order by i rows between 2 preceding and current row) as covered from r),
repeated as (select doc_id, count(*) filter (covered) as n from c group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from d),
l as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words, row_number() over (partition by doc_id, line order by i) > 1 as again, trim({low}, {edges}) as low,
  rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, length(line) - length(replace(line, '|', '')) as bars, {signs} as signs from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
f as (select *, case when again then 'repeated' when bars >= 2 and bars >= {rules.bar_share} * words then 'navigation' when signs > {rules.sign_share} * words and signs > 2 then 'signs'
  when words >= {rules.shout_words} and regexp_matches(line, '[A-Z]') and not regexp_matches(line, '[a-z0-9]') then 'shouting' when words <= {rules.boilerplate_words} and ({phrases}) then 'boilerplate'
  when words > {rules.plain_words} and not ({ends}) and not (contains(line, '. ') or contains(line, ', ') or contains(line, '? ') or contains(line, '! ')) then 'punctuation' else '' end as why from l),
k as (select doc_id, cast(coalesce(sum(words) filter (why = ''), 0) as bigint) as kept_words, count(*) filter (again) as dup from f group by doc_id),
why as (select doc_id, string_agg(why || ':' || n, ',' order by why) as failed_rules from (select doc_id, why, count(*) as n from f where why <> '' group by doc_id, why) group by doc_id),
b as (select d.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(t) - length(translate(t, {quoted(SIGNS)}, '')) as n_symbols, coalesce(dup, 0) as n_dup_lines,
  coalesce(repeated.n, 0) as n_repeat_words, coalesce(kept_words, 0) as kept_words, coalesce(failed_rules, '') as failed_rules from d left join repeated using (doc_id) left join k using (doc_id) left join why using (doc_id)),
v as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and kept_words >= {rules.min_kept} * n_words as kept, kept_words, failed_rules from v"""
