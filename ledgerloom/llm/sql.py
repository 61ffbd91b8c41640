"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from ledgerloom.llm.secrets import BASE, EXAMPLE_OWNERS, KINDS, LIVE_OWNERS

OP8 = """
with own as (select doc_id, coalesce(text, '') as text from documents),
groups as (select text, max(doc_id) as keep_id, count(*) as group_size from own group by text)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(text) as text_sha256
from own join groups using (text)
"""

#: Base 32 of the SHA-1: each five hex digits are four letters.
OP2 = """
with own as (select page_id, coalesce(html, '') as html from pages),
groups as (select html, max(page_id) as winner from own group by html),
digests as (select html, winner, octet_length(encode(html)) as payload_bytes, sha1(html) as hex from groups),
lettered as (
  select html, winner, payload_bytes, array_to_string(list_transform(range(8), lambda k:
    array_to_string(list_transform([15, 10, 5, 0], lambda s:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, k * 5 + 1, 5))::bigint >> s) & 31) + 1, 1)), '')), '') as payload_digest
  from digests)
select page_id, payload_bytes, payload_digest, case when page_id = winner then 'response' else 'revisit' end as record_type,
  case when page_id <> winner then winner end as refers_to
from own join lettered using (html)
"""

#: The mixture of op4: named sources with their weights, all others under the name '*' with the rest.
OP4 = """
with recursive weights(name, weight) as (values ('src0', 0.10::double), ('src1', 0.15::double), ('src2', 0.15::double), ('*', 0.60::double)),
named as (select *, case when source in ('src0', 'src1', 'src2') then source else '*' end as name from documents),
rates as (
  select name, any_value(weight) / (select sum(weight) from weights) * (select count(*) from named) / count(*) as rate
  from named join weights using (name) group by name),
terms as (select name, rate, k::int as k, exp(k * ln(rate) - rate - lgamma(k + 1)) as p from rates, range(0, 150) t(k)),
steps as (select name, k, sum(p) over (partition by name order by k) as total from terms),
numbers as (select doc_id, source, name, text, ('0x' || substr(md5('7:' || doc_id), 1, 13))::bigint / 4503599627370496.0::double as u from named),
counts as (select doc_id, source, text, count(s.k) as n from numbers d left join steps s on s.name = d.name and s.total <= d.u group by all)
select doc_id, source, copy::int as copy, md5('7#' || doc_id || '#' || copy) as mix_key, text
from counts, unnest(range(1, n + 1)) t(copy)
"""

ORACLES: dict[str, str] = {"op2_warc": OP2, "op4_mixing": OP4, "op8_exact": OP8}

#: Sets as lists of shingle texts; links by shared shingles; components by following links.
OP10 = r"""
with recursive worded as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from worded),
elements as (select doc_id, unnest(s) as e from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from elements a join elements b on a.e = b.e and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b
  where 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
reached(doc_id, r) as (select doc_id, doc_id from sets union select doc_id, b from reached join links on a = r)
select sets.doc_id, any_value(len(s))::bigint as n_shingles, min(r) as component_id from sets join reached using (doc_id) group by sets.doc_id
"""

ORACLES["op10_jaccard"] = OP10

#: Every string of 400 bytes by its start; those whose digest comes twice cover runs, which are cut out.
OP7 = r"""
with raw as (select doc_id, encode(coalesce(text, '')) as b from documents),
starts as (select doc_id, unnest(range(1, greatest(octet_length(b) - 398, 1))) as p, b from raw),
strings as (select doc_id, p, md5(b[p:p + 399]) as h from starts),
twice as (select h from strings group by h having count(*) > 1),
covered as (select doc_id, p, p - lag(p) over (partition by doc_id order by p) as step from strings join twice using (h)),
numbered as (select doc_id, p, sum(case when step <= 400 then 0 else 1 end) over (partition by doc_id order by p) as run from covered),
runs as (select doc_id, run, min(p) as a, max(p) + 399 as z from numbered group by all),
bounds as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 as since from runs),
parts as (
  select doc_id, since as o, b[since:a - 1] as part from bounds join raw using (doc_id) where a > since
  union all
  select doc_id, coalesce(max(z), 0) + 1 as o, any_value(b)[coalesce(max(z), 0) + 1:octet_length(any_value(b))] from raw left join runs using (doc_id) group by doc_id),
kept as (select doc_id, sha256(unhex(coalesce(string_agg(hex(part), '' order by o), ''))) as kept_sha256 from parts group by doc_id),
counts as (select doc_id, sum(z - a + 1)::bigint as n_removed, count(*) as n_spans from runs group by doc_id),
worded as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
windows as (select doc_id, p, md5(array_to_string(w[p:p + 50], ' ')) as h from (select doc_id, w, unnest(range(1, greatest(len(w) - 49, 1))) as p from worded)),
again as (select h from windows group by h having count(*) > 1),
passages as (select doc_id, count(*) as n_passage_words from (select distinct doc_id, unnest(range(p, p + 51)) as k from windows join again using (h)) group by doc_id)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, kept_sha256, coalesce(n_passage_words, 0) as n_passage_words
from raw join kept using (doc_id) left join counts using (doc_id) left join passages using (doc_id)
"""

ORACLES["op7_repeats"] = OP7


def secrets_sql() -> str:
    """Matches by splitting at each pattern, owners by value over all documents."""
    each = []
    for rank, kind in enumerate(KINDS):
        pattern = kind.pattern.replace("'", "''")
        each.append(f"""
  select doc_id, owner, repository, {rank} as rank, '{kind.name}' as kind, {kind.least} as least, unnest(range(1, len(whole) + 1)) as i, pieces, whole, value from (
    select doc_id, owner, repository, string_split_regex(t, '{pattern}') as pieces, regexp_extract_all(t, '{pattern}', 0) as whole, regexp_extract_all(t, '{pattern}', {kind.value}) as value
    from own where regexp_matches(t, '{pattern}'))""")
    counts = ", ".join(f"count(*) filter (where kind = '{k.name}') as n_{k.name}" for k in BASE)
    return f"""
with own as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as owner, coalesce(source, '') || chr(31) || coalesce(lang, '') as repository from documents),
found as ({' union all '.join(each)}),
placed as (
  select doc_id, owner, repository, rank, kind, value[i] as v, length(whole[i]) as size,
    list_sum(list_transform(pieces[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0)::bigint as a
  from found where length(value[i]) >= least),
owners as (select v, count(distinct owner) as n, count(distinct repository) as r from placed group by v),
judged as (
  select *, kind || ':' || a || ':' || (a + size) as said, rank < {len(BASE)} as base, n <= {LIVE_OWNERS} as live, least(n, r) >= {EXAMPLE_OWNERS} as example,
    case when n <= {LIVE_OWNERS} then 'live' when least(n, r) >= {EXAMPLE_OWNERS} then 'example' else 'unclear' end as verdict
  from placed join owners using (v)),
told as (
  select doc_id, {counts}, string_agg(said, ',' order by a, rank) filter (where base) as base_spans, string_agg(said, ',' order by a, rank) filter (where base or not example) as spans,
    string_agg(said || ':' || verdict, ',' order by a, rank) as verdicts,
    count(*) filter (where live) as n_live, count(*) filter (where example) as n_example from judged group by doc_id)
select doc_id, {', '.join(f'coalesce(n_{k.name}, 0) as n_{k.name}' for k in BASE)}, sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(verdicts, '') as verdicts,
  coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example from own left join told using (doc_id)
"""


ORACLES["op5_secrets"] = secrets_sql()

#: CRC-32 bit by bit; equal words p apart by a join on words, stretches of them as islands, the least period of each stretch.
OP12 = r"""
with crcs as (
  select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) as h,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
sized as (select doc_id, h % 10 = 0 and len(w) > 0 as planted, h // 10 as g, len(w)::bigint as n, w from crcs),
tails as (select *, case when n > 0 then g % n end as a from sized),
texts as (
  select doc_id, n, case when planted then list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end + 1]) else w end as w
  from tails),
words as (select doc_id, n, unnest(range(n)) as i, unnest(w) as word from texts),
pairs as (
  select a.doc_id, a.i, b.i - a.i as p from words a join words b on a.doc_id = b.doc_id and a.word = b.word and b.i > a.i and 4 * (b.i - a.i) <= a.n),
islands as (select doc_id, p, i, i - row_number() over (partition by doc_id, p order by i) as island from pairs),
stretches as (select doc_id, p, min(i) as s, max(i) + 1 + p as e from islands group by doc_id, p, island),
runs as (select doc_id, s, e, min(p) as p from stretches where e - s >= greatest(6, 4 * p) group by all),
dropped as (select distinct doc_id, unnest(range(s + p, e)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as said from words anti join dropped using (doc_id, i) group by doc_id),
told as (
  select doc_id, count(*) as n_runs, string_agg(s || ',' || (e - s) || ',' || p || chr(10), '' order by s, p) as said,
    first({'s': s, 'n': e - s, 'p': p} order by e - s desc, s, p) as longest
  from runs group by doc_id)
select t.doc_id, coalesce(n_runs, 0) as n_runs, longest.s as start, longest.n as length, longest.p as period, 1000 * longest.n // longest.p as exponent_milli,
  sha256(coalesce(told.said, '')) as runs_sha256, sha256(coalesce(kept.said, '')) as collapsed_sha256
from texts t left join told using (doc_id) left join kept using (doc_id)
"""

ORACLES["op12_periods"] = OP12
