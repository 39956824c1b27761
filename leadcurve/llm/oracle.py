"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from leadcurve.llm.licenses import SPREAD, TEMPLATES

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format

MIXING_SQL = """
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
           ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 15))::bigint as hash
    from documents
), sources as (
    select source, sum(size)::bigint as s, 2.0::double * sum(size) as cap,
           [5.0::double, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w
    from sized group by source
), tried as (
    -- the level at which the sources before this one in the order of cap / w are full
    select a.source,
           (select 1.5::double * sum(s) - coalesce(sum(cap) filter (where (cap / w, coalesce('=' || source, 'null')) < (a.cap / a.w, coalesce('=' || a.source, 'null'))), 0) from sources)
           / (select sum(w) filter (where (cap / w, coalesce('=' || source, 'null')) >= (a.cap / a.w, coalesce('=' || a.source, 'null'))) from sources) as level,
           a.cap / a.w as turn
    from sources a
), targets as (
    select source, s, least(cap, w * coalesce((select max(level) from tried where level <= turn), 1e300)) as target from sources
), plans as (
    select *, case when s > 0 then floor(target / s) else 0 end::bigint as every,
           target - (case when s > 0 then floor(target / s) else 0 end) * s as rest
    from targets
), steps as (
    select source, hash, sum(size) as here, count(*) as members, sum(sum(size)) over (partition by source order by hash) as upto
    from sized group by source, hash
), numbered as (select *, row_number() over (partition by source, hash) as number from sized)
select d.doc_id, d.size, p.s as source_size, p.target,
       (d.size * (p.every + case when p.rest <= 0 then 0 when h.upto <= p.rest then 1
           when h.upto - h.here < p.rest and number <= floor((p.rest - (h.upto - h.here)) / (h.here / h.members) + 0.5) then 1 else 0 end))::bigint as taken
from numbered d
join plans p on d.source is not distinct from p.source
join steps h on d.source is not distinct from h.source and d.hash = h.hash
"""

#: Everything a row reaches over links a - b, by row.
_REACHED = """
both_ways as (select a, b from links union all select b, a from links),
reached(origin, met) as (
    select id, id from ids
    union
    select r.origin, l.b from reached r join both_ways l on l.a = r.met
), smallest as (select origin as id, min(met) as component_id from reached group by origin)
"""

JACCARD_SQL = f"""
with recursive texts as (
    select doc_id, regexp_extract_all({_LOWER("text")}, '[^\\x20\\x09-\\x0D]+') as w from documents
), shingles as (
    select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from texts where len(w) > 0)
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
    select m.a, m.b
    from (select x.doc_id as a, y.doc_id as b, count(*) as c from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2) m
    join sizes p on p.doc_id = m.a join sizes q on q.doc_id = m.b
    where 100 * c >= 75 * (p.n + q.n - c)
), ids as (select doc_id as id from documents),
{_REACHED}
select d.doc_id, coalesce(s.n, 0) as n_shingles, c.component_id
from documents d left join sizes s using (doc_id) join smallest c on c.id = d.doc_id
"""

EMBEDDINGS_SQL = f"""
with recursive ids as (select vec_id as id from embeddings),
sound as (
    select vec_id, embedding::double[] as e from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select x.vec_id as a, y.vec_id as b from sound x join sound y on x.vec_id < y.vec_id
    where list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)) >= 0.9
),
{_REACHED}
select e.vec_id, (select count(*) from both_ways l where l.a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join smallest c on c.id = e.vec_id
"""

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_NOTICES = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)

LICENSES_SQL = f"""
with notices as (
    select row_number() over () as notice, label, w, list_distinct(w) as t, {SPREAD} * len(w) as span
    from (select label, regexp_extract_all({_LOWER("notice")}, '{_WORD}') as w from (values {_NOTICES}) as n(label, notice))
), wanted as (select notice, unnest(t) as word from notices), texts as (select doc_id, regexp_extract_all({_LOWER("text")}, '{_WORD}') as w from documents),
words as (select doc_id, unnest(w) as w0, generate_subscripts(w, 1) - 1 as place from texts),
ahead as (
    select *, lead(w0, 1) over o as w1, lead(w0, 2) over o as w2, lead(w0, 3) over o as w3
    from words window o as (partition by doc_id order by place)
), places as (
    select doc_id, place, case when w0 = 'gnu' and w1 = 'general' and w2 = 'public' and w3 = 'license' then 'gpl'
        when w0 = 'apache' and w1 = 'license' then 'apache' when w0 = 'cc' and w1 = 'by' then 'cc-by'
        when w0 = 'mit' and w1 = 'license' then 'mit' end as label
    from ahead
), found as (select * from places where label is not null),
spots as (select doc_id, notice, place, w0 as word from words join wanted on word = w0),
enough as (select doc_id, notice from spots join notices using (notice) group by doc_id, notice, len(t) having count(distinct word) >= 0.9 * len(t)),
near as (
    select a.doc_id, a.notice, a.place, count(distinct b.word) as shared
    from enough e join spots a on a.doc_id = e.doc_id and a.notice = e.notice join notices n on n.notice = a.notice
    join spots b on b.doc_id = a.doc_id and b.notice = a.notice and b.place >= a.place and b.place < a.place + n.span
    group by a.doc_id, a.notice, a.place
), matches as (
    select doc_id, label, shared::double / len(t)::double as c from near join notices using (notice) where shared >= 0.9 * len(t)
), every as (select doc_id, label from found union select doc_id, label from matches)
select d.doc_id, len(d.w)::bigint as n_words,
    (select count(*) from found f where f.doc_id = d.doc_id) as n_base,
    (select min(place) from found f where f.doc_id = d.doc_id)::bigint as first_word,
    (select max(place) from found f where f.doc_id = d.doc_id)::bigint as last_word,
    coalesce((select string_agg(distinct label, ',' order by label) from found f where f.doc_id = d.doc_id), '') as base_labels,
    coalesce((select string_agg(distinct label, ',' order by label) from every f where f.doc_id = d.doc_id), '') as labels,
    coalesce((select max(c) from matches m where m.doc_id = d.doc_id), if(exists (select 1 from found f where f.doc_id = d.doc_id), 1.0, 0.0))::double as score
from texts d
"""

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

SEARCH_SQL = f"""
with texts as (select row_number() over () as doc, doc_id, regexp_extract_all({_LOWER("text")}, '{_TERM}') as w from documents),
queries as (
    select item, item_id, unnest(list_distinct(regexp_extract_all({_LOWER("text")}, '{_TERM}'))) as term
    from (select row_number() over () as item, * from benchmark)
), counts as (select count(*)::bigint as docs, sum(len(w))::bigint as words from texts where len(w) > 0),
held as (
    select doc, term, count(*)::bigint as tf from (select doc, unnest(w) as term from texts) where term in (select term from queries) group by doc, term
), weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, counts group by term, docs),
measured as (select doc, doc_id, 10 + (90 * len(w)::bigint * docs) // words as m from texts, counts where len(w) > 0),
scored as (
    select q.item, q.item_id, m.doc_id, h.doc, sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * m.m)))::bigint as score
    from queries q join held h on h.term = q.term join weights w on w.term = q.term join measured m on m.doc = h.doc
    group by q.item, q.item_id, m.doc_id, h.doc
), ranked as (select *, row_number() over (partition by item order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""

ORACLE_SQL = {
    "op3_mixing": MIXING_SQL,
    "op6_jaccard": JACCARD_SQL,
    "op8_embeddings": EMBEDDINGS_SQL,
    "op9_licenses": LICENSES_SQL,
    "op11_search": SEARCH_SQL,
}
