"""What the queries return, said in SQL over whole tables; plain joins, meant for small data."""

from __future__ import annotations

from fieldscope.llm import licenses, secrets

PAGES = """
with p as (
    select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), best as (
    select payload_digest, payload_bytes, max(page_id) as best from p where payload_bytes >= 1000 group by all
)
select page_id, payload_bytes, payload_digest,
    case when page_id < best then 'revisit' else 'response' end as record_type,
    case when page_id < best then best end as refers_to
from p left join best using (payload_digest, payload_bytes)
"""

WORD_WINDOWS = r"""
with d as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), win as (
    select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)
), first as (select g, min(doc_id) as least from win group by g),
cut as (
    select doc_id, list(distinct p) as gone from (
        select doc_id, unnest(range(i, i + 50)) as p from win join first using (g) where least < doc_id) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
    sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, p: not list_contains(gone, p)) end, ' ')) as kept_sha256
from d left join cut using (doc_id)
"""

BYTE_STRINGS = """
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
win as (select doc_id, i, md5(hex(b[i:i + 99])) as g from (select doc_id, b, unnest(range(1, n - 98)) as i from d)),
first as (select g, min((doc_id, i)) as least from win group by g),
lost as (select doc_id, i from win join first using (g) where least < (doc_id, i)),
ends as (select *, max(i + 100) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before from lost),
marked as (select *, sum(case when before is null or i > before then 1 else 0 end) over (partition by doc_id order by i) as span from ends),
spans as (select doc_id, span, min(i) as a, max(i) + 100 as z from marked group by all),
gaps as (select doc_id, list(a order by a) as a, list(z order by a) as z, sum(z - a)::bigint as n_removed, count(*) as n_spans from spans group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
    sha256(case when n_spans is null then b else unhex(array_to_string(list_transform(range(0, n_spans + 1),
        lambda k: substring(hex(b), 2 * (case when k = 0 then 1 else z[k] end) - 1, 2 * ((case when k = n_spans then n + 1 else a[k + 1] end) - (case when k = 0 then 1 else z[k] end)))), '')) end) as kept_sha256
from d left join gaps using (doc_id)
"""


def secret_spans() -> str:
    """All rules' matches with the text between them, and the lengths summed up."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = quote(rule.pattern)
        parts.append(
            f"select doc_id, {rank} as rank, '{rule.kind}' as kind, {rule.least} as least, string_split_regex(t, {pattern}) as gaps, "
            f"regexp_extract_all(t, {pattern}, 0) as hits, regexp_extract_all(t, {pattern}, {rule.group}) as vals from d where regexp_matches(t, {pattern})"
        )
    base = ", ".join(f"'{r.kind}'" for r in secrets.RULES if r.base)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.RULES if r.base)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), m as ({" union all ".join(parts)}),
flat as (select doc_id, rank, kind, least, n, length(gaps[n]) as gap, length(hits[n]) as size, length(vals[n]) as held
    from (select *, unnest(range(1, len(hits) + 1)) as n from m)),
placed as (select *, (sum(gap + size) over (partition by doc_id, kind order by n))::bigint as z from flat),
s as (select doc_id, rank, kind, z - size as a, z from placed where held >= least),
texts as (select doc_id, {counts}, string_agg(kind || ':' || a || ':' || z, ',' order by a, rank) as spans,
    string_agg(kind || ':' || a || ':' || z, ',' order by a, rank) filter (kind in ({base})) as base from s group by doc_id)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.RULES if r.base)},
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join texts using (doc_id)
"""


SPLIT = r"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
SHINGLES = "list_transform(range(1, greatest(len({w}) - 3, 1)), lambda k: array_to_string({w}[k:k + 4], ' '))"


def leaks() -> str:
    """Every item-sized window of the documents that share a shingle with an item."""
    return f"""
with d as (select doc_id, {SPLIT.format(text="text")} as w from documents),
i as (select item_id, {SPLIT.format(text="text")} as w from benchmark), items as (select item_id, w, len(w) as m, {SHINGLES.format(w="w")} as s from i where len(w) >= 5),
ds as (select distinct doc_id, unnest({SHINGLES.format(w="w")}) as s from d where len(w) >= 5), item_shingles as (select distinct item_id, unnest(s) as s from items),
pairs as (select distinct doc_id, item_id from ds join item_shingles using (s)),
win as (select doc_id, item_id, m, st, w[st + 1:st + m] as v from (
    select doc_id, item_id, m, d.w, unnest(range(0, greatest(len(d.w) - m, 0) + 1)) as st from pairs join d using (doc_id) join items using (item_id))),
wsh as (select doc_id, item_id, st, s, count(*) as c from (select doc_id, item_id, st, unnest({SHINGLES.format(w="v")}) as s from win) group by all),
ish as (select item_id, s, count(*) as c from (select item_id, unnest(s) as s from items) group by all),
common as (select doc_id, item_id, st, sum(least(wsh.c, ish.c)) as b from wsh join ish using (item_id, s) group by all),
sizes as (select doc_id, item_id, st, sum(c) as n from wsh group by all),
scored as (select doc_id, item_id, st, (b / (n + len(items.s) - b))::double as sim from common join sizes using (doc_id, item_id, st) join items using (item_id))
select doc_id, item_id, arg_min(st, (-sim, st))::bigint as start, max(sim) as similarity from scored where sim >= 0.8 group by all
"""


def license_matches() -> str:
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in licenses.TEMPLATES)
    return f"""
with d as (select doc_id, {SPLIT.format(text="text")} as w from documents),
t as (select license, {SPLIT.format(text="text")} as w from (values {rows}) v(license, text)),
templates as (select license, w, len(w) as m, list_distinct({SHINGLES.format(w="w")}) as s from t),
ds as (select distinct doc_id, unnest({SHINGLES.format(w="w")}) as s from d where len(w) >= 5),
pairs as (select distinct doc_id, license, w, m from ds join (select license, w, m, unnest(s) as s from templates) using (s)),
win as (select doc_id, license, tw, st, w[st + 1:st + 2 * m] as v from (
    select doc_id, license, pairs.w as tw, m, d.w, unnest(range(0, greatest(len(d.w) - 2 * m, 0) + 1)) as st from pairs join d using (doc_id))),
held as (select doc_id, license, st, s, {SHINGLES.format(w="v")} as vs from win join (select license, w as tw, s from templates) using (license, tw)),
scored as (select doc_id, license, (len(list_intersect(list_distinct(vs), s)) / len(s))::double as c,
    st + list_position(list_transform(vs, lambda x: list_contains(s, x)), true) - 1 as place from held)
select doc_id, license, arg_min(place, (-c, place))::bigint as start, max(c) as containment from scored where c >= 0.8 group by all
"""

INFILL = r"""
with d as (
    select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h,
        regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u from documents
), k as (
    select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d
), c as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
            when h4 % 100 < 50 then 'spm' else 'psm' end as form from k
), p as (
    select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(t) as restored_sha256
from p
"""

RANKED = r"""
with d as (
    select row_number() over () as r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents
), s as (select count(*)::bigint as N, sum(len(w))::bigint as L from d where len(w) > 0),
p as (select r, t, count(*)::bigint as tf from (select r, unnest(w) as t from d) group by all),
f as (select t, floor(1000 * ln((2 * N + 2)::double / (2 * count(*) + 1)::double))::bigint as wt from p, s group by t, N),
q as (
    select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark
), m as (select r, doc_id, 100 - 90 + ((90 * len(w) * N) // L) as m from d, s where len(w) > 0),
found as (
    select item_id, doc_id, r, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
    from q join f using (t) join p using (t) join m using (r) group by all
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from found where score > 0 qualify rank <= 10
"""
