"""DuckDB text for the queries that SQL can express; meant for small tables."""

from .chat_prefix import END, ESCAPES, TEXT, TURN
from .collocations import BEST as BEST_PHRASES
from .collocations import CONTAINED, LEAST, LONGEST
from .divergence import BEST, LEAST_DOCS, PRIOR, SCALE
from .line_dedup import LEAST_WORDS

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""
with recursive w as (select doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
reach as (select doc_id, doc_id as r from w union select reach.doc_id, e.b from reach join e on e.a = reach.r)
select w.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from w left join n on n.doc_id = w.doc_id join (select doc_id, min(r) as component_id from reach group by doc_id) m on m.doc_id = w.doc_id"""

SUBSTRING = f"""
with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 18)) as i, w from w where len(w) >= 20),
k as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as g from win),
f as (select g, min((doc_id, i)) as first from k group by g),
gone as (select distinct k.doc_id, unnest(range(k.i, k.i + 20)) as i from k join f on f.g = k.g where f.first < (k.doc_id, k.i)),
each as (select doc_id, unnest(range(1, len(w) + 1)) as i, w from w),
kept as (select e.doc_id, string_agg(e.w[e.i], ' ' order by e.i) as t, count(*) as n from each e where not exists (select 1 from gone where gone.doc_id = e.doc_id and gone.i = e.i) group by e.doc_id)
select w.doc_id, len(w.w) as n_words, len(w.w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256 from w left join kept on kept.doc_id = w.doc_id"""


def _escaped(c: str) -> str:
    for plain, code in ESCAPES:
        c = f"replace({c}, '{plain}', '{code}')"
    return c


CHAT = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p as (select *, {len(TURN) + len(TEXT) + len(END)} + length({_escaped("role")}) + length({_escaped("text")}) as size from c),
r as (select *, sum(size) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto, row_number() over (partition by conv_id order by turn, role, text) as k, count(*) over (partition by conv_id) as n from p)
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by k)) as turns_sha256,
  length(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_chars, sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_sha256,
  sum(case when role = 'assistant' or k = n then upto else 0 end)::bigint as formatted_chars, count(*) filter (role = 'assistant' or k = n) as n_examples
from r group by conv_id"""

LINES = rf"""
with a as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place, unnest(string_split(text, chr(10))) as raw from documents where text is not null),
l as (select doc_id, place, raw, trim(raw, ' ') as line, string_split(trim(raw, ' '), ' ') as w from a),
every as (select line, any_value(w) as w, min((doc_id, place)) as first from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by line),
f as (select * from every where len(w) >= {LEAST_WORDS}),
v as (select line, first, len(w) as n, unnest(range(1, len(w) + 1)) as i, w from f),
d as (select line, first, n, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') as rest from v),
near as (select x.line from d x join (select n, i, rest, min(first) as least from d group by all) g on g.n = x.n and g.i = x.i and g.rest = x.rest where g.least < x.first
  union select f.line from f join d on d.rest = f.line where d.first < f.first
  union select d.line from d join f on d.rest = f.line where f.first < d.first),
j as (select l.doc_id, l.place, l.raw, f.first is not null and (l.line in (select line from near) or f.first < (l.doc_id, l.place)) as gone from l left join every f on f.line = l.line),
k as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(raw, chr(10) order by place) filter (not coalesce(gone, false)), '') as kept from j group by doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed, case when d.text is null then null else sha256(k.kept) end as kept_sha256 from documents d left join k on k.doc_id = d.doc_id"""

DIVERGENCE = rf"""
with d as (select row_number() over () as id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from w group by all having count(distinct id) >= {LEAST_DOCS}),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct lang, source from d),
n as (select lang, source, term, count(*) as n from w join k using (lang, term) group by all),
ng as (select g.lang, g.source, coalesce(sum(n.n), 0) as total from g left join n using (lang, source) group by all),
nl as (select lang, sum(total) as total from ng group by lang),
p as (select ng.lang, ng.source, k.term, coalesce(n.n, 0) as c, 1 + ({SCALE} * (coalesce(n.n, 0)::hugeint + {PRIOR})) // (ng.total + {PRIOR} * v.v)::hugeint as p
  from ng join k on k.lang = ng.lang join v on v.lang = ng.lang left join n on n.lang = ng.lang and n.source = ng.source and n.term = k.term),
q as (select k.lang, k.term, 1 + ({SCALE} * (coalesce(sum(n.n), 0)::hugeint + {PRIOR})) // (any_value(nl.total) + {PRIOR} * any_value(v.v))::hugeint as q
  from k join nl on nl.lang = k.lang join v on v.lang = k.lang left join n on n.lang = k.lang and n.term = k.term group by k.lang, k.term),
s as (select a.lang, a.source, 'pair' as part, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
e as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select p.lang, p.source, 'term', p.term, p.p - q.q from p join q using (lang, term) where p.c > 0 and p.p > q.q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from e)
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= {BEST}"""

COLLOCATIONS = rf"""
with d as (select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
e as (select lang, id, generate_subscripts(w, 1) as i, unnest(w) as w1 from w),
h as (select lang, w1, lead(w1, 1) over x as w2, lead(w1, 2) over x as w3, lead(w1, 3) over x as w4 from e window x as (partition by id order by i)),
g as (select lang, 1 as m, w1 as g from h union all select lang, 2, concat(w1, ' ', w2) from h where w2 is not null
  union all select lang, 3, concat(w1, ' ', w2, ' ', w3) from h where w3 is not null union all select lang, 4, concat(w1, ' ', w2, ' ', w3, ' ', w4) from h where w4 is not null),
f as (select lang, m, g, count(*) as a from g group by all having count(*) >= {LEAST}),
c as (select *, string_split(g, ' ') as w from f where m > 1),
k as (select c.*, k from c, (select unnest(range(1, {LONGEST})) as k) where k < m),
s as (select k.lang, k.g, k.m, k.a, k.k, x.a as l, y.a as r, ((2000000 * k.a::hugeint) // (x.a + y.a)::hugeint)::bigint as score
  from k join f x on x.lang = k.lang and x.g = array_to_string(k.w[:k.k], ' ') join f y on y.lang = k.lang and y.g = array_to_string(k.w[k.k + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, g order by score, k) = 1),
i as (select c.lang, c.a, array_to_string(c.w[x:x + z - 1], ' ') as g from c, (select unnest(range(1, {LONGEST + 1})) as x), (select unnest(range(2, {LONGEST})) as z) where z < c.m and x + z - 1 <= c.m),
o as (select lang, g, max(a) as most from i group by all),
q as (select b.* from b left join o using (lang, g) where o.most is null or 100 * o.most::hugeint < {CONTAINED} * b.a::hugeint)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(g)) as rank, g as phrase, a, l, r, n, score from q join n using (lang) qualify rank <= {BEST_PHRASES}"""

ORACLES = {"op4_ngram_jaccard_join": JACCARD, "op6_chat_prefix": CHAT, "op7_substring_dedup": SUBSTRING, "op8_line_dedup": LINES, "op13_phrase_collocations": COLLOCATIONS, "op12_source_divergence": DIVERGENCE}
