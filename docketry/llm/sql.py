"""DuckDB SQL for the queries that SQL can express."""

CHAT = r"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), stepped as (
  select *, lag(role) over w as before, lead(turn) over w is null as is_last
  from given window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text)
                  filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10))
      + length(replace(replace(text, chr(92), chr(92) || 'b'), '<|', '<' || chr(92) || 'p')))::bigint as formatted_chars,
  bool_and(case when before is null then role in ('system', 'user') when before = 'system' then role = 'user'
                when before = 'user' then role = 'assistant' when before = 'assistant' then role = 'user'
                else false end)
    and max_by(role, (turn, role, text)) = 'assistant' as valid
from stepped group by conv_id
"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
with docs as (select doc_id, {ITEM_WORDS} as words from documents),
items as (select item_id, words, least(10, len(words)) as n
  from (select item_id, {ITEM_WORDS} as words from benchmark) where len(words) > 0),
windows as (select distinct item_id, n, array_to_string(list_slice(words, k, k + n - 1), ' ') as w
  from (select *, unnest(range(1, len(words) - n + 2)) as k from items)),
places as (select doc_id, n, k, array_to_string(list_slice(words, k, k + n - 1), ' ') as w
  from (select *, unnest(range(1, len(words) - n + 2)) as k
    from docs cross join (select distinct n from windows) where len(words) >= n)),
found as (select doc_id, k, n, item_id from places join windows using (n, w)),
hit as (select doc_id, count(distinct k + j) as n_hit from (select doc_id, k, unnest(range(n)) as j from found) group by 1),
named as (select doc_id, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as id from found) group by 1)
select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from docs left join hit using (doc_id) left join named using (doc_id)
"""

JACCARD = rf"""
with recursive docs as (
  select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as words from documents),
shingles as (select distinct doc_id, s from (
  select doc_id, array_to_string(list_slice(words, k, k + 4), ' ') as s
  from (select *, unnest(range(1, len(words) - 3)) as k from docs where len(words) >= 5)
  union all select doc_id, array_to_string(words, ' ') from docs where len(words) between 1 and 4)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * s.n >= 75 * (x.n + y.n - s.n)),
steps as (select a, b from links union all select b, a from links),
reached as (select doc_id, doc_id as other from docs
  union select r.doc_id, s.b from reached r join steps s on s.a = r.other)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from (select doc_id, min(other) as component_id from reached group by 1) left join sizes using (doc_id)
"""

WARC = """
with payloads as (select page_id, coalesce(html, '') as html from pages),
firsts as (select html, min(page_id) as first from payloads group by 1),
hexed as (select page_id, first, strlen(html) as payload_bytes, sha1(html) as h from payloads join firsts using (html))
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((cast('0x' || substr(h, (i // 4) * 5 + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from hexed
"""

REPEATS = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
starts as (select doc_id, s, md5(substr(h, 2 * s + 1, 200)) as w
  from (select *, unnest(range(n - 99)) as s from docs where n >= 100)),
firsts as (select w, min((doc_id, s)) as first from starts group by 1),
later as (select doc_id, s from starts join firsts using (w) where (doc_id, s) <> first),
apart as (select *, coalesce(s - lag(s) over (partition by doc_id order by s) > 100, true) as is_new from later),
spans as (select doc_id, min(s) as low, max(s) + 100 as high from (
  select *, count(*) filter (is_new) over (partition by doc_id order by s) as span from apart) group by doc_id, span),
gaps as (select doc_id, high as low, coalesce(lead(low) over (partition by doc_id order by low, high), n) as high
  from (select doc_id, 0 as low, 0 as high, n from docs where doc_id in (select doc_id from spans)
    union all select doc_id, low, high, n from spans join docs using (doc_id))),
kept as (select doc_id, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' order by low, high) as h
  from gaps join docs using (doc_id) group by 1),
removed as (select doc_id, cast(sum(high - low) as bigint) as n_removed, count(*) as n_spans from spans group by 1)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(k.h, d.h))) as kept_sha256
from docs d left join removed using (doc_id) left join kept k using (doc_id)
"""

COLLOCATIONS = rf"""
with pieces as (select coalesce(lang, 'und') as lang, regexp_extract_all(p, '[^\x20\x09]+') as words
  from (select lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')) as p from documents)),
total as (select lang, sum(len(words))::bigint as n from pieces group by 1),
phrases as (select lang, k, array_to_string(list_slice(words, i, i + k - 1), ' ') as phrase, count(*) as f
  from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i
    from pieces cross join (select unnest(range(1, 5)) as k) where len(words) >= k)
  group by all having count(*) >= 30),
cuts as (select lang, k, phrase, f, unnest(range(1, k)) as cut from phrases),
parts as (select *, array_to_string(list_slice(string_split(phrase, ' '), 1, cut), ' ') as head,
  array_to_string(list_slice(string_split(phrase, ' '), cut + 1, k), ' ') as tail from cuts),
scored as (select p.lang, p.k, p.phrase, p.f as a, h.f as l, t.f as r, p.cut,
  (2000000::hugeint * p.f // (h.f + t.f))::bigint as score
  from parts p join phrases h on h.lang = p.lang and h.phrase = head join phrases t on t.lang = p.lang and t.phrase = tail),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_runs as (select lang, array_to_string(list_slice(string_split(phrase, ' '), i, i + m - 1), ' ') as phrase, max(f) as longer
  from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from phrases where k > 2))
  group by all),
kept as (select b.* from best b left join inner_runs using (lang, phrase) where longer is null or 100 * longer < 80 * a)
select lang, row_number() over w as rank, phrase, a, l, r, n, score from kept join total using (lang)
window w as (partition by lang order by score desc, a desc, encode(phrase)) qualify rank <= 2000
"""

HARD_NEGATIVES = """
with given as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, a.label = b.label as is_same, b.vec_id,
    cast(list_dot_product(a.v, b.v) as bigint) as score
  from given a join given b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where is_same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as int) as rank, n.vec_id as negative_id,
  positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.is_same
  and 80 * positive_score <= 100 * n.score and n.score <= positive_score
window w as (partition by p.anchor_id, positive_id order by n.score desc, n.vec_id) qualify rank <= 5
"""
