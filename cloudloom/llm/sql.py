"""DuckDB SQL for the operators of this subpackage that SQL can express, by query name."""

from __future__ import annotations

import re

from .chat import CONTROL, LEARNED_ROLE, RESERVED
from .neardup import SHINGLE
from .quality import BLOCK_RATE, MAX_DUP_LINE_PERCENT, MAX_REPEAT_PERCENT, MAX_SYMBOL_PERCENT, MIN_WORDS, WATCH_RATE
from .resampling import BUCKETS, PERCENT, SEED
from .resampling import MIN_WORDS as MIN_DRAWN_WORDS
from .substring import WINDOW
from .suffixes import WINDOW as BYTES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
with d as (select doc_id, source, coalesce(text, '') as t, {_WORDS} as w, string_split(coalesce(text, ''), chr(10)) as l from documents),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i, len(w) as n from d),
grams as (select doc_id, i, n, word || ' ' || lead(word) over p || ' ' || lead(word, 2) over p as g from words window p as (partition by doc_id order by i)),
counted as (select doc_id, i, g is not null and count(*) over (partition by doc_id, g) > 1 as again from grams),
covered as (select doc_id, max(again::int) over (partition by doc_id order by i rows between 2 preceding and current row) as c from counted),
repeats as (select doc_id, sum(c)::bigint as r from covered group by doc_id),
m as (
  select d.doc_id, source, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(l) as n_lines,
    list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as worded, coalesce(r, 0)::bigint as n_repeat_words
  from d left join repeats using (doc_id)),
f as (
  select *, (len(worded) - len(list_distinct(worded)))::bigint as n_dup_lines,
    n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
    100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars or 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines as soft_failed
  from m),
h as (select source, count(*) as n, sum((base_failed or soft_failed)::int) as k from f group by source),
prior as (select least(greatest(avg(k / n), 1e-3), 1 - 1e-3) as mean, coalesce(var_samp(k / n), 0) as v from h),
strong as (select mean, case when v > 0 then least(greatest(mean * (1 - mean) / v - 1, 2.0), 1000.0) else 1000.0 end as s from prior),
rated as (select source, (k + mean * s) / (n + s) as rate from h, strong),
told as (select *, case when rate >= {BLOCK_RATE} then 'blocked' when rate >= {WATCH_RATE} then 'watch' else 'trusted' end as verdict from rated)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and verdict <> 'blocked' and not (verdict = 'watch' and soft_failed) as kept, soft_failed, floor(rate * 1e6 + 0.5) / 1e6 as host_rate, verdict
from f join told on f.source is not distinct from told.source
"""

NEAR_DUPLICATES = rf"""
with recursive w as (select doc_id, {_WORDS} as ws from documents),
s as (select doc_id, array_to_string(ws, ' ') as seq, len(ws) as n from w),
first as (select seq, min(doc_id) as rep from s where n > 0 group by seq),
member as (select doc_id, coalesce(rep, doc_id) as rep from s left join first on n > 0 and s.seq = first.seq),
p as (select rep, unnest(ws) as word, generate_subscripts(ws, 1) as i, len(ws) as n from w join first on doc_id = rep),
g as (select rep, i, n, string_agg(word, ' ') over (partition by rep order by i rows between current row and {SHINGLE - 1} following) as sh from p),
sh as (select rep, sh, count(*) as weight from g where i <= greatest(n - {SHINGLE - 1}, 1) group by rep, sh),
c as (select rep, sum(weight) as n from sh group by rep),
pairs as (select x.rep as a, y.rep as b, sum(least(x.weight, y.weight)) as m from sh x join sh y on x.sh = y.sh and x.rep < y.rep group by x.rep, y.rep),
links as (select a, b from pairs join c ca on ca.rep = a join c cb on cb.rep = b where 10 * m >= 8 * (ca.n + cb.n - m)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
class as (select a as rep, min(b) as label from reach group by a)
select doc_id, coalesce(least(label, member.rep), member.rep) as class_id, member.rep as copy_of from member left join class on member.rep = class.rep
"""

PASSAGES = rf"""
with w as (select doc_id, {_WORDS} as ws from documents),
p as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i, len(ws) as n from w),
win as (select doc_id, i, word, n, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and {WINDOW - 1} following) as g from p),
hashed as (select doc_id, i, word, case when i <= n - {WINDOW - 1} then sha256(g) end as h from win),
owner as (select h, min(doc_id) as lo from hashed where h is not null group by h),
judged as (select doc_id, i, word, coalesce(lo < doc_id, false) as late from hashed left join owner on hashed.h = owner.h),
cut as (select doc_id, i, word, max(late::int) over (partition by doc_id order by i rows between {WINDOW - 1} preceding and current row) as gone from judged),
summed as (select doc_id, count(*) as n, sum(gone) as r, string_agg(word, ' ' order by i) filter (where gone = 0) as kept from cut group by doc_id)
select w.doc_id, coalesce(n, 0)::bigint as n_words, coalesce(r, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join summed using (doc_id)
"""

_CONTROLS = "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True)))


def _escaped_chars(x: str) -> str:
    return f"(length({x}) + length({x}) - length(replace({x}, chr(92), '')) + len(regexp_extract_all({x}, '{_CONTROLS}')))"


CHAT = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r, text as x from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, x nulls first)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = '{LEARNED_ROLE}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, r nulls first, x nulls first) filter (where role = '{LEARNED_ROLE}'), '')) as loss_sha256,
  (sum({_escaped_chars("role")} + {_escaped_chars("text")} + {sum(map(len, RESERVED[1:]))}) + {len(RESERVED[0])})::bigint as formatted_chars
from t group by conv_id
"""

BYTE_STRINGS = f"""
with d as (select row_number() over () as r, doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
s as (select r, doc_id, h, length(h) // 2 as n from d),
piece as (select r, doc_id, n, unnest(range(0, n - {BYTES - 1}, 256)) as a, h from s where n >= {BYTES} and doc_id is not null),
part as (select r, doc_id, a, least(256, n - {BYTES - 1} - a) as m, substr(h, 2 * a + 1, 2 * (256 + {BYTES - 1})) as h from piece),
win as (select r, doc_id, a, unnest(range(m)) as j, h from part),
cut as (select r, doc_id, a + j as i, md5(substr(h, 2 * j + 1, {2 * BYTES})) as w from win),
owner as (select w, min(doc_id) as lo from cut group by w),
late as (select r, i from cut join owner on cut.w = owner.w where doc_id > lo),
edge as (select r, i, i > lag(i) over p + {BYTES} or lag(i) over p is null as new from late window p as (partition by r order by i)),
run as (select r, i, sum(new::int) over (partition by r order by i) as g from edge),
span as (select r, min(i) as a, max(i) + {BYTES} as b from run group by r, g),
gap as (select r, a, b, lead(a) over (partition by r order by a) as next, row_number() over (partition by r order by a) as k from span),
kept as (
  select s.r, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans,
    max(case when k = 1 then substr(h, 1, 2 * a) end) || string_agg(substr(h, 2 * b + 1, 2 * (coalesce(next, n) - b)), '' order by a) as rest
  from gap join s using (r) group by s.r)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256
from s left join kept using (r)
"""

RESAMPLING = rf"""
with recursive crc(step, b, c) as (
  select 0, b, b from (select unnest(range(256))::bigint as b)
  union all select step + 1, b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where step < 8),
crcs as (select list(c order by b) as t from crc where step = 8),
texts as (
  select 'd' as side, row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all select 'b', row_number() over (), null, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
w as (select side, r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from texts),
f as (
  select side, r, unnest(ws) as g from w
  union all select side, r, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from w where len(ws) > 1),
grams as (select distinct g from f),
bytes as (select g, list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda x: ('0x' || x)::bigint) as bs from grams),
bucketed as (select g, xor(list_reduce(list_prepend(4294967295, bs), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} as bucket from bytes, crcs),
fb as (select side, r, bucket from f join bucketed using (g)),
n as (select bucket, count(*) filter (where side = 'd') as s, count(*) filter (where side = 'b') as t from fb group by bucket),
total as (select coalesce(sum(s), 0)::bigint as s, coalesce(sum(t), 0)::bigint as t from n),
gain as (select bucket, floor(1000 * ln(((n.t + 1)::double * (total.s + {BUCKETS})::double) / ((n.s + 1)::double * (total.t + {BUCKETS})::double)))::bigint as gain from n, total),
weighed as (select r, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from fb join gain using (bucket) where side = 'd' group by r),
scored as (
  select w.r, doc_id, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint as score
  from w left join weighed using (r) where side = 'd'),
placed as (select r, row_number() over (order by score desc, doc_id nulls last) as place, count(*) over () as able from scored where n_words >= {MIN_DRAWN_WORDS})
select doc_id, n_features, weight, score, case when place <= {PERCENT} * able // 100 then place end as rank from scored left join placed using (r)
"""

ORACLES = {"op1_quality_rules": QUALITY, "op4_minhash_near_dedup": NEAR_DUPLICATES, "op5_substring_dedup": PASSAGES, "op7_chat_format": CHAT, "op11_suffix_dedup": BYTE_STRINGS, "op12_importance_resampling": RESAMPLING}
