"""DuckDB counterparts of the registered queries, where SQL can express them."""

OP1 = """
with d as (select doc_id, case when coalesce(text, '') = '' then [] else string_split(text, chr(10)) end as ls from documents),
l as (
  select doc_id, pos, list_filter(string_split(regexp_replace(regexp_replace(raw, '[\\t\\r\\f\\x0B]', ' ', 'g'), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' '), lambda x: x <> '') as w
  from (select doc_id, unnest(ls) as raw, unnest(range(1, len(ls) + 1)) as pos from d)
), f as (
  select doc_id, pos, array_to_string(w, ' ') as line, len(w) as n, concat_ws(' ', len(w), w[1], w[2]) as leaf, w from l where len(w) > 0
), leaves as (select leaf from f group by leaf having count(distinct doc_id) >= 3),
u as (select line, any_value(leaf) as leaf, any_value(w) as w, any_value(n) as n, least(count(*), 3) as times from f semi join leaves using (leaf) group by line),
p as (select line, leaf, times, unnest(w) as word, unnest(range(1, n + 1)) as i from u),
c as (select leaf, i, word from p group by all having sum(times) >= 3),
k as (select line, count(*) filter (where i > 2) as m, string_agg(i || ':' || word, ' ' order by i) as consts from p join c using (leaf, i, word) group by line),
t as (select line, case when m > 0 and m >= 0.6 * (n - 2) then 'T ' || leaf || ' | ' || consts else 'L ' || line end as template from u left join k using (line)),
r as (select template from f join t using (line) group by template having count(distinct doc_id) >= 3),
gone as (select doc_id, pos from f join t using (line) semi join r using (template)),
kept as (
  select doc_id, string_agg(raw, chr(10) order by pos) as kept from (select doc_id, unnest(ls) as raw, unnest(range(1, len(ls) + 1)) as pos from d) anti join gone using (doc_id, pos) group by doc_id
), g as (select doc_id, count(*) as n_dropped from gone group by doc_id)
select d.doc_id, cast(len(ls) as bigint) as n_lines, coalesce(n_dropped, 0) as n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id) left join g using (doc_id)
"""

OP7 = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
), g as (
  select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm
)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""

OP6 = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as sh from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by all
), e as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)
), r(doc_id, reach) as (
  select doc_id, doc_id from w union select r.doc_id, e.b from r join e on e.a = r.reach
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, min(r.reach) as component_id from w left join n using (doc_id) join r using (doc_id) group by w.doc_id, n.n
"""

OP9 = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (
  select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)
), f as (select h, min(doc_id) as first_doc from win group by h),
gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as p from win join f using (h) where first_doc < doc_id
), g as (select doc_id, list(p order by p) as ps from gone group by doc_id),
x as (select doc_id, w, coalesce(ps, []) as ps from d left join g using (doc_id)),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as t from (
    select d.doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d
  ) anti join gone using (doc_id, p) group by doc_id
)
select x.doc_id, cast(len(w) as bigint) as n_words, cast(len(ps) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from x left join kept using (doc_id)
"""

_ITEM_WORDS = "regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10 = f"""
with d as (select doc_id, {_ITEM_WORDS.format(t="text")} as w from documents),
b as (select cast(item_id as varchar) as item_id, {_ITEM_WORDS.format(t="text")} as w from benchmark),
bw as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) as i from b where len(w) > 0)
), ks as (select distinct k from bw),
dw as (
  select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as win
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)
), m as (select doc_id, i, k, item_id from dw join bw using (k, win)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, i, k from m)) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from m) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


#: crc32 as SQL: a table of 256 steps, then one step a byte.
OP11 = """
with recursive steps as (
  select list(list_reduce(cast(range(8) as bigint[]), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) order by i) as step from (select unnest(range(256)) as i)
), r as (
  select run, count(*) as n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as h
  from (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents) group by doc_id, run
), c as (
  select run, n, xor(list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda k: cast('0x' || substr(h, 2 * k - 1, 2) as bigint)), lambda a, b: xor(step[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) as crc from r, steps
), w as (
  select case when crc % 31 = 0 then substr(run, 1, cast(crc % len(run) as int)) || substr(run, cast(crc % len(run) as int) + 2) else run end as word, cast(sum(n) as bigint) as n from c group by 1
), words as (select word, n from w where len(word) >= 7 and n >= 2),
less as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, len(word) + 1)) as i from words)),
near as (
  select a.word, b.word as other from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select l.word, x.word from less l join words x on x.word = l.rest union select x.word, l.word from less l join words x on x.word = l.rest
), best as (
  select near.word, count(*) as n_near, min({'n': -o.n, 'w': other}) as b from near join words o on o.word = other group by 1
), forms as (
  select words.word, words.n, coalesce(n_near, 0) as n_near, case when -b.n >= 10 * words.n then b.w end as form, case when -b.n >= 10 * words.n then -b.n end as form_n from words left join best using (word)
), way(word, root, next) as (
  select word, word, form from forms union all select way.word, forms.word, forms.form from way join forms on forms.word = way.next
)
select f.word, form, root, f.n, n_near, form_n from forms f join way on way.word = f.word and way.next is null
"""

OP12 = """
with d as (
  select doc_id, source is null as none, coalesce(source, '') as name, substr(md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 16) as key,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
), s as (
  select none, name, cast(sum(size) as bigint) as source_size, [5, 2, 1][(row_number() over (order by none, name) - 1) % 3 + 1] as weight from d group by none, name
), caps as (select a.none, a.name, a.weight, a.source_size, 3 * a.source_size as cap from s a),
levels as (
  select a.none, a.name, (select sum(source_size) from caps) - coalesce(sum(b.cap) filter (where b.cap * a.weight < a.cap * b.weight), 0) as words,
    sum(b.weight) filter (where b.cap * a.weight >= a.cap * b.weight) as share, any_value(a.cap) as cap, any_value(a.weight) as weight
  from caps a, caps b group by a.none, a.name
), level as (select words, share from levels where weight * words <= cap * share order by cap * 1.0 / weight limit 1),
t as (
  select none, name, source_size, case when weight * words > cap * share then cast(cap as double) else cast(cast(weight * words as bigint) as double) / cast(share as bigint) end as target
  from caps, level
), p as (
  select d.*, source_size, target, cast(floor(target) as bigint) as budget, coalesce(sum(size) over (partition by none, name order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from d join t using (none, name)
)
select doc_id, size, source_size, target,
  cast(case when source_size = 0 then 0 else budget // source_size * size + greatest(0, least(size, budget % source_size - before)) end as bigint) as taken
from p
"""

OP13 = """
with t as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), f as (
  select doc_id, part, len(w) < 200 as a, 100 * coalesce(list_unique(w), 0) < 50 * len(w) as b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by text), false) as e from t
), m as (
  select part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} as fails, count(*) as n, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as toxic
  from f left join labels using (doc_id) group by all
), l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s as (select filter_order, cast(unnest(range(1, 6)) as integer) as step from o),
r as (
  select part, filter_order, step, substr(filter_order, step, 1) as x, n, good, toxic, list_transform(string_split(filter_order, ''), lambda q: fails[q]) as places,
    list_position(places, true) as gone_at, len(list_filter(places, lambda q: q)) as failed from m, s
), g as (
  select part, filter_order, step, x, cast(sum(case when gone_at is null or gone_at > step then n else 0 end) as bigint) as kept, cast(sum(case when gone_at = step then n else 0 end) as bigint) as removed,
    cast(sum(case when places[step] and gone_at < step then n else 0 end) as bigint) as redundant, cast(sum(case when places[step] and failed = 1 then n else 0 end) as bigint) as unique_fails,
    cast(sum(case when gone_at = step then good else 0 end) as bigint) as good_lost, cast(sum(case when gone_at = step then toxic else 0 end) as bigint) as toxic_lost
  from r group by part, filter_order, step, x
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley from g
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op6_jaccard_join": OP6, "op7_exact_dedup": OP7, "op9_substring_dedup": OP9, "op10_decontaminate": OP10, "op11_spelling_variants": OP11, "op12_source_mix": OP12, "op13_filter_audit": OP13}
