"""SQL for the queries that SQL can express."""

from __future__ import annotations

from starmill.llm.licenses import COMMON, TEMPLATES

_DEMAND = """
    case rank % 3
    when 0 then case when share * 1.0::double < 1.0::double
        then 0.0::double + (sqrt(greatest(4.0::double + -4.0::double * (share * 1.0::double - 0.0::double), 0.0::double))
                            - 2.0::double) / -2.0::double
        else 1.0::double end
    when 1 then case when share * 1.0::double < 1.0::double
        then 0.0::double + (share * 1.0::double - 0.0::double) / 1.0::double else 1.0::double end
    else case when share * 1.0::double < 0.25::double
        then 0.0::double + (sqrt(greatest(0.0::double + 4.0::double * (share * 1.0::double - 0.0::double), 0.0::double))
                            - 0.0::double) / 2.0::double
        when share * 1.0::double < 1.0::double
        then 0.5::double + (sqrt(greatest(1.0::double + 4.0::double * (share * 1.0::double - 0.25::double), 0.0::double))
                            - 1.0::double) / 2.0::double
        else 1.0::double end
    end
"""

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# The licence sentences are parameters of the query, so both sides read the same ones.
_TEMPLATE_ROWS = ", ".join(f"({k}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(TEMPLATES))
_COMMON = ", ".join(f"'{w}'" for w in sorted(COMMON))

ORACLES = {
    "op5_mixing": rf"""
with recursive sized as (
    select doc_id, source,
        cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
        md5(coalesce(cast(doc_id as varchar), '')) as draw
    from documents),
sources as (
    select *, (rank % 3) + 1 as weight
    from (select source, cast(sum(size) as bigint) as source_size,
                 row_number() over (order by source nulls last) - 1 as rank
          from sized group by source)),
-- one round at a time: give the free sources an even share, fix those that it would overfill
rounds as (
    select 0 as step, source, false as fixed from sources
    union all
    select step + 1, source, fixed or level * weight > 3 * source_size
    from (
        select r.step, r.source, r.fixed, s.weight, s.source_size,
            ((sum(s.source_size) over ()) - coalesce(sum(case when r.fixed then 3 * s.source_size end) over (), 0))::double
            / (sum(case when not r.fixed then s.weight end) over ())::double as level
        from rounds r join sources s on r.source is not distinct from s.source)
    where step < (select count(*) from sources)),
settled as (select source, fixed from rounds where step = (select count(*) from sources)),
plan as (
    select s.source, s.source_size, s.rank,
        case when t.fixed then (3 * s.source_size)::double else
            ((sum(s.source_size) over ()) - coalesce(sum(case when t.fixed then 3 * s.source_size end) over (), 0))::double
            / (sum(case when not t.fixed then s.weight end) over ())::double * s.weight::double end as target
    from sources s join settled t on s.source is not distinct from t.source),
placed as (
    select d.doc_id, d.size, p.source_size, p.target, p.rank, cast(floor(p.target + 0.5) as bigint) as goal,
        cast(coalesce(sum(d.size) over (partition by p.rank order by d.draw, d.doc_id nulls first, d.size
            rows between unbounded preceding and 1 preceding), 0) as bigint) as ahead
    from sized d join plan p on d.source is not distinct from p.source),
counted as (
    select *, cast(coalesce(goal // nullif(source_size, 0), 0) * size + greatest(0, least(size,
            goal - coalesce(goal // nullif(source_size, 0), 0) * source_size - ahead)) as bigint) as taken,
        ahead::double / nullif(goal, 0)::double as share
    from placed)
select doc_id, size, source_size, target, taken,
    case when taken > 0 then cast(floor(({_DEMAND}) * 1000000) as bigint) end as position
from counted
""",
    "op8_minhash_near_dup": rf"""
with recursive tokens as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x20\x09-\x0D]+') as w from documents),
shingled as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
    from tokens),
flat as (select doc_id, len(s) as n, unnest(s) as x from shingled),
shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as n_both, any_value(a.n) as na, any_value(b.n) as nb
    from flat a join flat b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared where 100 * n_both >= 85 * (na + nb - n_both)),
either as (select a, b from links union select b, a from links),
reach as (select a as node, b as other from either union select r.node, e.b from reach r join either e on r.other = e.a),
least_id as (select node, min(other) as low from reach group by node)
select d.doc_id, cast(len(d.s) as bigint) as n_shingles,
    cast(least(d.doc_id, coalesce(l.low, d.doc_id)) as bigint) as component_id,
    d.doc_id <= coalesce(l.low, d.doc_id) as kept
from shingled d left join least_id l on d.doc_id = l.node
""",
    "op6_dual_tree_top_k": """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.vec_id as query_id, b.vec_id as vec_id,
        cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint) as score
    from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select * from (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
    from scored)
where rank <= 5
""",
    "op3_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (
    select doc_id, i, substring(h, 2 * i + 1, 200) as s
    from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) as i from d)),
later as (
    select doc_id, i from windows
    qualify row_number() over (partition by s order by doc_id, i) > 1),
numbered as (
    select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run
    from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as fresh
          from later)),
runs as (select doc_id, run, min(i) as a, max(i) + 100 as b from numbered group by doc_id, run),
gaps as (
    select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from runs),
cut as (
    select g.doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last_end,
        string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head
    from gaps g join d on g.doc_id = d.doc_id group by g.doc_id)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
    cast(coalesce(n_spans, 0) as bigint) as n_spans,
    sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(last_end, 0) + 1))) as kept_sha256
from d left join cut c on d.doc_id = c.doc_id
""",
    "op10_license_scan": rf"""
with templates(template, label, sentence, phrase) as (values {_TEMPLATE_ROWS}),
sentences as (
    select template, label,
        list_filter(regexp_split_to_array(translate(sentence, {_UPPER}), '[^a-z0-9]+'), lambda x: x <> '') as w,
        list_filter(regexp_split_to_array(translate(phrase, {_UPPER}), '[^a-z0-9]+'), lambda x: x <> '') as p
    from templates),
started as (
    select *, list_filter(range(1, len(w) + 1), lambda i: w[i : i + len(p) - 1] = p)[1] as origin from sentences),
index as (
    select template, label, i - 1 as place, w[i] as word, (i >= origin and i < origin + len(p))::int as needed
    from (select *, unnest(range(1, len(w) + 1)) as i from started)
    where (i >= origin and i < origin + len(p)) or w[i] not in ({_COMMON})),
docs as (
    select row_number() over () as r, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
    from documents),
places as (
    select r, w[i] as word, i - 1 as place, w from (select r, w, unnest(range(1, len(w) + 1)) as i from docs)
    where w[i] in (select word from index)),
weights as (
    select word, round(ln(((select count(*) from docs) + 1)::double / (count(distinct r) + 1)) + 1.0, 6) as weight
    from (select r, word from places union all select null, word from index) group by word),
aligned as (
    select p.r, i.template, i.label, p.place - i.place as shift, sum(weight) as weight, sum(i.needed) as needed
    from places p join index i on p.word = i.word join weights g on g.word = i.word group by all),
totals as (select template, sum(weight) as whole, sum(needed) as all_needed from index join weights using (word) group by template),
agreed as (
    select r, list(distinct label) as found, max(weight / whole) as best
    from aligned join totals using (template)
    where needed = all_needed and weight / whole >= 0.6 group by r),
base as (
    select r, phrase, label, i - 1 as place
    from (select r, w, unnest(range(1, len(w) + 1)) as i from docs),
        (values (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) as b(phrase, label)
    where w[i] = phrase[1] and w[i : i + len(phrase) - 1] = phrase),
based as (select r, count(*) as n, min(place) as first_word, max(place) as last_word, list(distinct label) as labels from base group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base,
    cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
    coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(found, [])))), ','), '') as labels,
    case when n > 0 then 1.0 else round(least(coalesce(best, 0.0), 1.0), 6) end as score
from docs d left join based b on d.r = b.r left join agreed a on d.r = a.r
""",
    "op12_divergence_cube": rf"""
with d as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents),
found as (select lang, source, term, count(*) as n, count(distinct r) as docs
    from (select r, lang, source, unnest(w) as term from d) group by all),
words as (select lang, term, sum(n) as n from found group by all having sum(docs) >= 3),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as size from words group by lang),
counted as (select f.* from found f join words using (lang, term)),
groups as (
    select distinct d.lang, d.source, coalesce(s.size, 0)::hugeint as size
    from d left join (select lang, source, sum(n) as size from counted group by all) s
        on d.lang = s.lang and d.source = s.source),
dense as (
    select g.lang, g.source, w.term, coalesce(c.n, 0) as n,
        1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.size + l.v) as p,
        1 + 1000000000::hugeint * (w.n + 1) // (l.size + l.v) as q
    from groups g join words w on g.lang = w.lang join langs l on g.lang = l.lang
    left join counted c on g.lang = c.lang and g.source = c.source and w.term = c.term),
sums as (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
    from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join sums s on a.lang = s.lang and a.source = s.source and b.source = s.item),
terms as (
    select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from dense where n > 0 and p > q),
ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank
    from (select * from pairs union all select * from terms))
select lang, source, part, item, value::bigint as value, rank::integer as rank from ranked where part = 'pair' or rank <= 200
""",
}
