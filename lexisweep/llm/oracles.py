"""SQL for the queries that SQL can express, as DuckDB runs it."""

import string

from lexisweep.llm.secrets import EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES

NEARDUP = rf"""with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
sets as (
  select doc_id, case
    when len(w) >= 5 then list_distinct(list_transform(
      range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as shingles
  from words),
sizes as (select doc_id, len(shingles) as n_shingles from sets),
each as (select doc_id, unnest(shingles) as shingle from sets),
pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as c
  from each a join each b using (shingle) where a.doc_id <> b.doc_id group by all),
links as (
  select u, v from pairs join sizes x on x.doc_id = u join sizes y on y.doc_id = v
  where 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)),
reached as (
  select doc_id, doc_id as other from sizes
  union
  select reached.doc_id, v from reached join links on other = u)
select doc_id, any_value(n_shingles) as n_shingles, min(other) as component_id,
       doc_id = min(other) as kept
from reached join sizes using (doc_id) group by doc_id"""


def _either_case(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_KINDS = [
    ("assign", rf"""({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("opaque", "[A-Za-z0-9+/_-]+", 0, 20),
]
_FOUND = " union all ".join(
    f"""select doc_id, source, lang, {number} as kind, {least} as least,
    regexp_split_to_array(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as whole,
    regexp_extract_all(text, '{pattern}', {group}) as part from texts"""
    for number, (_, pattern, group, least) in enumerate(_KINDS)
)
_NAMES = "[" + ", ".join(f"'{name}'" for name, *_ in _KINDS) + "]"

SECRETS = f"""with texts as (
  select doc_id, source, lang, coalesce(text, '') as text from documents),
found as ({_FOUND}),
each as (
  select *, unnest(range(1, len(whole) + 1)) as i from found),
placed as (
  select doc_id, kind, part[i] as value, coalesce(source, '') as owner,
         concat_ws('/', source, lang) as repository,
         (list_sum(list_transform(gaps[1:i], lambda g: length(g)))
          + coalesce(list_sum(list_transform(whole[1:i - 1], lambda m: length(m))), 0))::bigint as start,
         length(whole[i]) as size
  from each where length(part[i]) >= least),
spans as (
  select *, start + size as stop from placed p
  where kind < 3 or regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
    and not exists (
      select 1 from placed b where b.doc_id = p.doc_id and b.kind < 3
        and b.start < p.start + p.size and p.start < b.start + b.size)),
owners as (
  select value, count(distinct owner) < {EXAMPLE_OWNERS}
         or count(distinct repository) < {EXAMPLE_REPOSITORIES} as live
  from spans group by value),
judged as (
  select *, {_NAMES}[kind + 1] || ':' || start || ':' || stop as written
  from spans join owners using (value))
select t.doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access,
       count(*) filter (kind = 2) as n_hex,
       sha256(coalesce(string_agg(written, ',' order by start, kind) filter (kind < 3), '')) as base_sha256,
       coalesce(string_agg(written, ',' order by start, kind) filter (kind < 3 or live), '') as spans,
       count(*) filter (live) as n_live
from texts t left join judged using (doc_id) group by t.doc_id"""


FILTERS = r"""with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                     lambda w: w <> '') as words
  from documents),
firsts as (select text, min(doc_id) as first from texts group by text),
fails as (
  select part, {
    A: len(words) < 50,
    B: 100 * len(list_distinct(words)) < 65 * len(words),
    C: 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    D: regexp_matches(text, '[#$%&*|]'),
    E: first < doc_id} as f,
    doc_id in (select doc_id from labels where quality = 1) as good,
    doc_id in (select doc_id from labels where toxic = 1) as toxic
  from texts join firsts using (text)),
each as (
  select part, good, toxic, concat(if(f.A, 'A', ''), if(f.B, 'B', ''), if(f.C, 'C', ''),
         if(f.D, 'D', ''), if(f.E, 'E', '')) as failed
  from fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (
  select filter_order, step, filter_order[step] as own, filter_order[:step - 1] as earlier
  from orders, (select unnest(range(1, 6))::int as step)),
tested as (
  select *, contains(failed, own) as fails_own,
         earlier <> '' and failed <> '' and
           translate(failed, earlier, '') <> failed as gone
  from each, steps),
counted as (
  select part, filter_order, step, own,
    count(*) filter (not fails_own and not gone) as kept,
    count(*) filter (fails_own and not gone) as removed,
    count(*) filter (fails_own and gone) as redundant,
    count(*) filter (failed = own) as unique_fails,
    count(*) filter (fails_own and not gone and good) as good_lost,
    count(*) filter (fails_own and not gone and toxic) as toxic_lost
  from tested group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley
from counted"""


_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
# The remainders of one byte, bit by bit, and then of bytes of text.
_CRC_BIT = "if(r % 2 = 1, xor(r // 2, 3988292384), r // 2)"
SPELLING = rf"""with recursive bits as (
  select range as byte, 0 as k, range::ubigint as r from range(256)
  union all select byte, k + 1, {_CRC_BIT} from bits where k < 8),
remainders as (select list(r order by byte) as of_byte from bits where k = 8),
runs as (
  select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents),
counted as (
  select doc_id, translate(run, {_LOWER}) as run, count(*) as n
  from runs where length(run) >= 7 group by all),
spelt as (
  select run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as code from counted),
hashed as (
  select run, n, xor(list_reduce(
    list_prepend(4294967295::ubigint, list_transform(range(1, length(code), 2),
      lambda i: ('0x' || code[i:i + 1])::ubigint)),
    lambda r, byte: xor(r // 256, of_byte[(xor(r, byte) % 256 + 1)::bigint])), 4294967295) as h
  from spelt, remainders),
erred as (
  select n, if(h % 31 = 0, run[:(h % length(run))::bigint] || run[(h % length(run))::bigint + 2:], run) as word
  from hashed),
words as (
  select word, sum(n)::bigint as n from erred
  where length(word) >= 7 group by word having sum(n) >= 2),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
holes as (select word, n, i, word[:i - 1] || word[i + 1:] as rest from places),
pairs as (
  select a.word, b.word as near, b.n from holes a join holes b
    on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select holes.word, words.word, words.n from holes join words on rest = words.word
  union select words.word, holes.word, holes.n from holes join words on rest = words.word),
nearest as (
  select word, count(*) as n_near, max(n) as most from pairs group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, if(most >= 10 * w.n, most, null) as form_n,
    (select min(near) from pairs p where p.word = w.word and p.n = most and most >= 10 * w.n) as form
  from words w left join nearest using (word)),
paths as (
  select word, word as here, form as onward from forms
  union all select paths.word, forms.word, forms.form
  from paths join forms on onward = forms.word)
select word, form, here as root, n, n_near, form_n
from forms join (select word, here from paths where onward is null) using (word)"""
