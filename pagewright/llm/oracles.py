"""DuckDB SQL of the opN queries that SQL can express.

The URL rules, the quality classifier, the token counts and the packing are tested against brute force instead.
"""

from __future__ import annotations

from pagewright.llm.licenses import TEMPLATES

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Reachable smallest ids over a table ``links(a, b)`` that holds both directions.
_REACH = """reach(node, low) as (
    select distinct a, a from links union select l.b, r.low from reach r join links l on l.a = r.node where r.low < l.b
)"""

_OP3 = f"""
with templates(label, template) as (values {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEMPLATES)}),
sets as (
    select label, list_distinct(regexp_extract_all(translate(template, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')) as t
    from templates
),
docs as (select doc_id, {_FOLD} as low from documents),
words as (select doc_id, low, regexp_extract_all(low, '{_WORD}') as w from docs),
lines as (select distinct doc_id, unnest(string_split(low, chr(10))) as line from docs),
blocks as (select doc_id, list_distinct(regexp_extract_all(line, '{_WORD}')) as b from lines),
met as (
    select doc_id, label, len(list_intersect(b, t)) / len(t) as share
    from blocks join sets on len(list_intersect(b, t)) >= ceil(0.8 * len(t) - 1e-9)
),
more as (select doc_id, list(distinct label) as labels, max(share) as score from met group by doc_id),
found as (
    select doc_id, len(w) as n_words,
        list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' and w[i + 2] = 'by') as p0,
        list_filter(range(len(w)), lambda i: w[i + 1] = 'general' and w[i + 2] = 'public' and w[i + 3] = 'license') as p1,
        list_filter(range(len(w)), lambda i: w[i + 1] = 'all' and w[i + 2] = 'rights' and w[i + 3] = 'reserved') as p2
    from words
),
base as (
    select doc_id, n_words, list_concat(list_concat(p0, p1), p2) as p,
        list_filter(['cc-by', 'gpl', 'reserved'], lambda x, i: len(case i when 1 then p0 when 2 then p1 else p2 end) > 0) as base
    from found
)
select b.doc_id, cast(n_words as bigint) as n_words, cast(len(p) as bigint) as n_base, list_min(p) as first_word, list_max(p) as last_word,
    array_to_string(base, ',') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(base, coalesce(m.labels, [])))), ',') as labels,
    case when len(p) > 0 then 1.0::double else coalesce(m.score, 0.0)::double end as score
from base b left join more m using (doc_id)
"""

_OP4 = f"""
with recursive vectors as (
    select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
    where label is not null and embedding is not null
),
links as (
    select x.vec_id as a, y.vec_id as b from vectors x join vectors y on x.label = y.label and x.vec_id <> y.vec_id
    where list_cosine_similarity(x.v, y.v) >= 0.93
),
{_REACH},
low as (select node, min(low) as low from reach group by node),
degree as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, coalesce(l.low, e.vec_id) as component_id, coalesce(l.low, e.vec_id) = e.vec_id as kept
from embeddings e left join degree d on d.a = e.vec_id left join low l on l.node = e.vec_id
"""

_SHINGLES = "list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))"

_OP5 = f"""
with item_words as (select distinct item_id, regexp_extract_all(lower(text), '{_WORD}') as w from benchmark),
doc_words as (select doc_id, regexp_extract_all(lower(text), '{_WORD}') as w from documents),
item_sets as (select item_id, case when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct({_SHINGLES.format(k=5)}) end as s from item_words where len(w) > 0),
doc_sets as (
    select doc_id, unnest(list_distinct({_SHINGLES.format(k=5)})) as s from doc_words where len(w) >= 5
    {" ".join(f"union all select doc_id, unnest(list_distinct({_SHINGLES.format(k=k)})) from doc_words where len(w) >= {k} and exists (from item_words i where len(i.w) = {k})" for k in range(1, 5))}
),
items as (select item_id, len(s) as n, unnest(s) as s from item_sets)
select doc_id, item_id, count(*)::int as n_shared, any_value(n)::int as n_item, count(*) / any_value(n) as containment
from doc_sets join items using (s) group by doc_id, item_id having count(*) >= ceil(0.8 * any_value(n) - 1e-9)
"""

_OP6 = """
with recursive calls as (
    select c.conv_id, c.turn, c.text, p.turn is not null as follows
    from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 2 and p.role = 'user'
    where c.role = 'user'
),
levels(conv_id, turn, level) as (
    select conv_id, turn, 0 from calls where not follows
    union all
    select c.conv_id, c.turn, l.level + 1 from levels l join calls c on c.conv_id = l.conv_id and c.turn = l.turn + 2 and c.follows
)
select 'call' as kind, c.conv_id, concat(c.conv_id, ':', c.turn) as call_id, c.turn, 0 as position, l.level, r.turn as result_turn, '' as errors,
    concat('{"arguments":{', case when c.follows then concat('"after":{"$ref":"', c.conv_id, ':', c.turn - 2, '"},') else '' end,
        case when c.text is null then '' else concat('"text":', to_json(c.text), ',') end, '"turn":', c.turn, '},"id":"', c.conv_id, ':', c.turn, '","name":"reply",',
        case when r.turn is null then '' else concat('"result":{', case when r.text is null then '' else concat('"content":', to_json(r.text), ',') end, '"turn":', r.turn, '},') end,
        '"turn":', c.turn, '}') as json
from calls c join levels l on l.conv_id = c.conv_id and l.turn = c.turn
left join conversations r on r.conv_id = c.conv_id and r.turn = c.turn + 1 and r.role = 'assistant'
union all
select 'orphan', a.conv_id, concat(a.conv_id, ':', a.turn - 1), a.turn, null, null, a.turn, '',
    concat('{', case when a.text is null then '' else concat('"content":', to_json(a.text), ',') end, '"id":"', a.conv_id, ':', a.turn - 1, '","turn":', a.turn, '}')
from conversations a where a.role = 'assistant' and not exists (from conversations c where c.conv_id = a.conv_id and c.turn = a.turn - 1 and c.role = 'user')
union all
select 'message', conv_id, null, turn, null, null, null, '',
    concat('{', case when text is null then '' else concat('"content":', to_json(text), ',') end, case when role is null then '' else concat('"role":', to_json(role), ',') end, '"turn":', turn, '}')
from conversations where role is null or role not in ('user', 'assistant', 'tool')
"""

_SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$""", 8),
    ("access", r"AKIA[A-Z0-9]+", "^(.*)$", 16),
    ("hex", r"[0-9a-f]{32,}", "^(.*)$", 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "^(.*)$", 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "^(.*)$", 32),
    ("prefixed", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]+", "^(.*)$", 20),
    ("login", r"://[A-Za-z0-9._%+-]+:[^\x00-\x20@/:]+@", r"^://[A-Za-z0-9._%+-]+:([^\x00-\x20@/:]+)@$", 3),
)

_PARTS = " union all ".join(
    f"select doc_id, {k} as kind_no, '{kind}' as kind, regexp_extract_all(text, '{find}') as hits, string_split_regex(text, '{find}') as rest, '{inner}' as inner_re, {least} as least from docs"
    for k, (kind, find, inner, least) in enumerate(_SECRETS)
)

_OP7 = f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
parts as ({_PARTS}),
spans as (
    select doc_id, kind_no, kind, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
        'hit': hits[i],
        'start': (list_sum(list_transform(rest[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint
    }})) as m, inner_re, least
    from parts where len(hits) > 0
),
good as (
    select doc_id, kind_no, kind, m.start as s, concat(kind, ':', m.start, ':', m.start + length(m.hit)) as span from spans
    where case kind when 'assign' then length(regexp_extract(m.hit, '{_SECRETS[0][2]}', 1))
        when 'login' then length(regexp_extract(m.hit, '{_SECRETS[6][2]}', 1)) else length(m.hit) end >= least
),
found as (
    select doc_id, count(*) filter (kind_no = 0) as n0, count(*) filter (kind_no = 1) as n1, count(*) filter (kind_no = 2) as n2,
        string_agg(span, ',' order by s, kind_no) filter (kind_no < 3) as base, string_agg(span, ',' order by s, kind_no) as spans
    from good group by doc_id
)
select d.doc_id, coalesce(n0, 0)::bigint as n_assign, coalesce(n1, 0)::bigint as n_access, coalesce(n2, 0)::bigint as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join found f using (doc_id)
"""

_OP8 = f"""
with recursive words as (select doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct({_SHINGLES.format(k=4)}) end as s from words
),
items as (select doc_id, len(s) as n, unnest(s) as x from sets),
pairs as (
    select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k
    from items a join items b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2
),
links as (select a, b from pairs where 100 * k >= 85 * (na + nb - k)),
{_REACH},
low as (select node, min(low) as low from reach group by node)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(l.low, s.doc_id) as component_id from sets s left join low l on l.node = s.doc_id
"""

ORACLES: dict[str, str] = {
    "op3_license_scans": _OP3,
    "op4_embedding_near_dedup": _OP4,
    "op5_benchmark_decontamination": _OP5,
    "op6_chat_formatting": _OP6,
    "op7_secret_scans": _OP7,
    "op8_ngram_jaccard": _OP8,
}
