"""SQL for the rows of those queries that it can express; mixing has its own."""

from strandlake.llm.decontaminate import PERCENT
from strandlake.llm.media import WIDTH
from strandlake.llm.pii import IBAN_LENGTHS, KINDS, LEAST as LEAST_SCORE, LOWERS, NEAR, PRIOR, RAISES
from strandlake.llm.substring_dup import LEAST_WORDS
from strandlake.llm.warc import LEAST

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str) -> str:
    """key and s, the list of distinct shingles; words have no spaces, so that joined ones differ as their lists do."""
    return f"""select {key}, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from (select {key}, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from {table})"""


NEAR_DUP = f"""
with recursive sets as ({_shingles("documents", "doc_id")}),
rows as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common, any_value(a.n) as n_a, any_value(b.n) as n_b
  from rows a join rows b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs where 100 * common >= 85 * (n_a + n_b - common)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from sets union select r.a, e.b from reach r join edges e on r.b = e.a),
least as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from sets join least using (doc_id)
"""

DECONTAMINATE = f"""
with docs as ({_shingles("documents", "doc_id")}), items as ({_shingles("benchmark", "item_id")}),
d as (select doc_id, unnest(s) as g from docs), i as (select item_id, len(s) as n_item, unnest(s) as g from items),
found as (select doc_id, item_id, count(*) as common, any_value(n_item) as n_item from d join i using (g) group by all)
select doc_id, item_id, common, n_item, common / n_item as containment from found where 100 * common >= {PERCENT} * n_item
"""

WARC = f"""
with own as (select page_id, coalesce(html, '') as p, strlen(coalesce(html, '')) as n from pages),
firsts as (select *, case when n >= {LEAST} then min(page_id) over (partition by p) else page_id end as f from own)
select page_id, n as payload_bytes, sha256(p) as payload_digest, case when f < page_id then 'revisit' else 'response' end as record_type,
  case when f < page_id then f end as refers_to from firsts
"""

_WORDS = "list_filter(string_split_regex(translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+'), lambda x: x <> '')"

#: Lines, and sentences in lines of several; a sentence ends behind a mark that white space or the line's end follows.
SUBSTRING_DUP = f"""
with own as (select row_number() over () as r, doc_id, sha256(coalesce(text, '')) as key, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select r, doc_id, key, unnest(l) as line, unnest(range(len(l))) as k from own),
placed as (select *, cast(coalesce(sum(length(line) + 1) over (partition by r order by k rows between unbounded preceding and 1 preceding), 0) as int) as start from lines),
whole as (select r, doc_id, key, k, line, start, {_WORDS % "line"} as w, false as inside from placed),
cut as (select r, doc_id, key, k, start, len(w) as words, string_split(regexp_replace(line, '([.!?]+)(\\s|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as p from whole),
pieces as (select r, doc_id, key, k, start, words, unnest(p) as line, unnest(range(len(p))) as j from cut),
parts as (select r, doc_id, key, k, line, cast(start + coalesce(sum(length(line)) over (partition by r, k order by j rows between unbounded preceding and 1 preceding), 0) as int) as start, {_WORDS % "line"} as w, words from pieces),
units as (select r, doc_id, key, k, line, start, inside, array_to_string(w, ' ') as u from whole where len(w) > 0
  union all select r, doc_id, key, k, line, start, true, array_to_string(w, ' ') from parts where len(w) >= {LEAST_WORDS} and len(w) < words),
ranked as (select *, first_value(doc_id) over o as keeper_doc_id, first_value(key) over o as keeper_key, first_value(start) over o as keeper_start from units window o as (partition by u order by doc_id nulls last, key, start)),
gone as (select * from ranked where (doc_id, key, start) is distinct from (keeper_doc_id, keeper_key, keeper_start))
select doc_id, start, cast(start + length(line) as int) as "end", keeper_doc_id, keeper_start from gone
where not inside or (r, k) not in (select (r, k) from gone where not inside)
"""

_BANDS = " || ',' || ".join(f"cast(count(*) filter (b[1] = '{d}') * 1000 // count(*) as varchar)" for d in "0123456789ABCDEF")

MEDIA = f"""
with raw as (select doc_id, encode(coalesce(text, '')) as b from documents),
padded as (select doc_id, octet_length(b) as n_bytes, greatest(1, (octet_length(b) + {WIDTH - 1}) // {WIDTH}) as n_rows, hex(b) as h from raw),
own as (select doc_id, n_bytes, n_rows, h || repeat('FF', n_rows * {WIDTH} - n_bytes) as h from padded),
octets as (select doc_id, unnest(regexp_extract_all(h, '..')) as b from own),
numbers as (select doc_id, b, cast('0x' || b as int) as v from octets),
moments as (select doc_id, {_BANDS} as shares, count(*)::hugeint as n, sum(v)::hugeint as one, sum(v * v)::hugeint as two from numbers group by doc_id),
features as (select doc_id, shares || ',' || (one * 1000 // n) || ',' || cast(floor(sqrt((n * two - one * one) * 1000000 // (n * n))) as bigint) as feature from moments),
bits as (select *, unhex(h) as p, unhex(hex(encode('P5' || chr(10) || '{WIDTH} ' || n_rows || chr(10) || '255' || chr(10))) || h) as image,
  flatten(list_transform(regexp_extract_all(right(h, 64), '..'), lambda x: list_transform(range(8), lambda k: (cast('0x' || x as bigint) >> k) & 1))) as tail from own)
select doc_id, n_bytes, octet_length(p) as payload_bytes, sha256(p) as payload_sha256,
  xor(list_reduce(list_prepend(4294967295, tail), lambda c, x: xor(c >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) as tail_crc32,
  octet_length(image) as media_bytes, sha256(image) as media_sha256, feature
from bits join features using (doc_id)
"""

#: Each pair of lines that are not blank, with the blank ones between, goes if it stands earlier. What goes does not depend on coarse chunks.
LINE_DUP = """
with own as (select row_number() over () as r, doc_id, sha256(coalesce(text, '')) as key, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as l from documents),
split as (select r, doc_id, key, text, l, unnest(l) as line, unnest(range(len(l))) as k from own),
placed as (select *, coalesce(sum(strlen(line) + 1) over (partition by r order by k rows between unbounded preceding and 1 preceding), 0) as s from split),
lines as (select r, doc_id, key, l, line, k, s, least(s + strlen(line) + 1, strlen(text)) as e, regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g') <> '' as words,
  right(text, 1) <> chr(10) and k = len(l) - 1 as open from placed where k < len(l) - 1 or line <> ''),
numbered as (select *, count(*) filter (words) over (partition by r order by k) as m from lines),
pairs as (select r, doc_id, key, m, s, array_to_string(l[k + 1:lead(k) over (partition by r order by k) + 1], chr(10)) as u, lead(k) over (partition by r order by k) as next from numbered where words),
ranked as (select r, m, doc_id, key, s, first_value(doc_id) over o as keeper, first_value(key) over o as keeper_key, first_value(s) over o as keeper_s from pairs where next is not null
  window o as (partition by u order by doc_id nulls last, key, s)),
again as (select r, m from ranked where (doc_id, key, s) is distinct from (keeper, keeper_key, keeper_s)),
marked as (select n.*, exists (select 1 from again a where a.r = n.r and (a.m = n.m or n.words and a.m = n.m - 1)) as gone from numbered n),
islands as (select *, k - row_number() over (partition by r, gone order by k) as island from marked),
ranges as (select r, min(s) - case when bool_or(open) and min(s) > 0 then 1 else 0 end as s, max(e) as e from islands where gone group by r, island),
spans as (select r, count(*) as n_removed, cast(sum(e - s) as bigint) as removed_bytes, string_agg(cast(s as bigint) || ':' || cast(e as bigint), ',' order by s) as spans from ranges group by r),
kept as (select r, coalesce(string_agg(line || case when open then '' else chr(10) end, '' order by k) filter (not gone), '') as kept, bool_or(gone and open) as ends from marked group by r),
texts as (select own.r, own.doc_id, own.text, n_removed, removed_bytes, spans, case when n_removed is null then text when ends and kept <> '' then left(kept, length(kept) - 1) else kept end as kept
  from own left join spans using (r) left join kept using (r))
select doc_id, coalesce(n_removed, 0) as n_removed, coalesce(removed_bytes, 0) as removed_bytes, cast(strlen(kept) as bigint) as kept_bytes, sha256(kept) as kept_sha256, coalesce(spans, '') as spans from texts
"""

_IBANS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
# The plain patterns. Of IBANs only those of countries in the registry, which must not touch an underscore either.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": rf"\b(?:{_IBANS})\b",
}
_FOUND = " union all ".join(f"select r, '{k}' as kind, {n} as o, t, string_split_regex(t, '{_PLAIN[k]}') as p, regexp_extract_all(t, '{_PLAIN[k]}') as m from own" for n, k in enumerate(KINDS))
_BY_KIND = lambda values, quote="": "case kind " + " ".join(f"when '{k}' then {quote}{values[k]}{quote}" for k in KINDS) + " end"
_COUNTS = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in KINDS)

PII = f"""
with own as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
found as ({_FOUND}),
single as (select r, kind, o, t, unnest(p[1:len(m)]) as p, unnest(m) as m, unnest(range(len(m))) as i from found where len(m) > 0),
placed as (select *, cast(sum(length(p)) over (partition by r, kind order by i) + coalesce(sum(length(m)) over (partition by r, kind order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as s,
  regexp_replace(m, '[^0-9]', '', 'g') as d, replace(m, ' ', '') as plain from single),
confirmed as (select * from placed where case kind
    when 'ip' then len(list_filter(string_split(m, '.'), lambda x: try_cast(x as hugeint) <= 255)) = 4
    when 'card' then length(d) between 16 and 19 and list_sum(list_transform(range(length(d)), lambda k: case when k % 2 = 0 then cast(d[length(d) - k] as int)
      else cast(d[length(d) - k] as int) * 2 - case when cast(d[length(d) - k] as int) > 4 then 9 else 0 end end)) % 10 = 0
    when 'phone' then length(d) between 8 and 15
    when 'iban' then list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(plain[5:] || plain[:4], ''), lambda c: cast(case when c <= '9' then ascii(c) - 48 else ascii(c) - 55 end as bigint))),
      lambda a, v: (a * case when v < 10 then 10 else 100 end + v) % 97) = 1
    else true end),
near as (select *, s + length(m) as e, t[greatest(s - {NEAR}, 0) + 1:s + length(m) + {NEAR}] as around from confirmed),
scored as (select *, round({_BY_KIND(PRIOR)}::double + case when regexp_matches(around, {_BY_KIND(RAISES, "'")}) then 0.2::double else 0.0::double end - case when regexp_matches(around, {_BY_KIND(LOWERS, "'")}) then 0.3::double else 0.0::double end, 1) as score from near),
kept as (select *, kind || ':' || s || ':' || e as span from scored where kind <> 'iban' or score >= {LEAST_SCORE}),
sums as (select r, {_COUNTS}, string_agg(span, ',' order by o, s) filter (kind <> 'iban') as base, string_agg(span, ',' order by o, s) as spans, string_agg(cast(score as varchar), ',' order by o, s) as scores from kept group by r)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores from own left join sums using (r)
"""
