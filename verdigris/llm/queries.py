"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline

from verdigris.llm.ann import op2_nearest
from verdigris.llm.decontaminate import op8_decontaminate
from verdigris.llm.filteraudit import op13_filter_audit
from verdigris.llm.htmltree import op11_main_text
from verdigris.llm.importance import op12_importance
from verdigris.llm.langid import op10_language_id
from verdigris.llm.neardup import op6_near_duplicates
from verdigris.llm.pieces import op3_pieces
from verdigris.llm.pii import op1_pii
from verdigris.llm.repeats import op5_repeats
from verdigris.llm.secrets import op4_secrets
from verdigris.llm.sharding import op9_shards
from verdigris.llm.tokenids import op7_token_ids


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_pii": op1_pii,
        "op2_nearest": op2_nearest,
        "op3_pieces": op3_pieces,
        "op4_secrets": op4_secrets,
        "op5_repeats": op5_repeats,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_token_ids": op7_token_ids,
        "op8_decontaminate": op8_decontaminate,
        "op9_shards": op9_shards,
        "op10_language_id": op10_language_id,
        "op11_main_text": op11_main_text,
        "op12_importance": op12_importance,
        "op13_filter_audit": op13_filter_audit,
    }


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
with recursive w as (select doc_id, coalesce(regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+'), []) ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) sh from w),
n as (select w.doc_id, count(s.sh) n from w left join s using (doc_id) group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b using (sh) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(node, other) as (select doc_id, doc_id from n union select r.node, e.b from r join e on r.other = e.a),
m as (select node, min(other) c from r group by 1)
select doc_id, n as n_shingles, c as component_id, doc_id = c as kept from n join m on node = doc_id"""

OP8_SQL = f"""
with w as (select doc_id, coalesce(regexp_extract_all({_LOW}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) ws from documents),
i as (select item_id, coalesce(regexp_extract_all({_LOW}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) ws from benchmark),
iw as (select distinct item_id, least(10, len(ws)) size, unnest(list_transform(range(1, greatest(1, len(ws) - 9) + 1), lambda p: array_to_string(ws[p:p + 9], ' '))) k from i where len(ws) > 0),
z as (select distinct size from iw),
dw as (select doc_id, size, unnest(range(1, len(ws) - size + 2)) p, ws from w, z where len(ws) >= size),
h as (select doc_id, dw.size, p, item_id, iw.k from dw join iw on iw.size = dw.size and iw.k = array_to_string(ws[p:p + dw.size - 1], ' ')),
c as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + size)) q from h) group by 1),
ip as (select item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) ip from i where len(ws) > 0),
x as (select doc_id, item_id, p, ip, size from h join ip using (item_id) where array_to_string(ip.ws[ip:ip + 9], ' ') = h.k),
y as (select *, p - row_number() over (partition by doc_id, item_id, p - ip order by p) run from x),
m as (select doc_id, item_id, min(p) - 1 p, min(ip) - 1 ip, count(*) + any_value(size) - 1 n from y group by doc_id, item_id, p - ip, run),
best as (select * from (select *, row_number() over (partition by doc_id order by n desc, p, ip, item_id desc) r from m) where r = 1),
t as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) items from (select distinct doc_id, item_id from h) group by 1)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated,
coalesce(n, 0) as longest_words, best.item_id as longest_item, p as longest_doc_word, ip as longest_item_word
from w left join c using (doc_id) left join t using (doc_id) left join best using (doc_id)"""

OP12_SQL = f"""
with tab as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) crc from range(256) r(i)),
w as (select row_number() over () n, doc_id, regexp_extract_all({_LOW.replace('text,', "coalesce(text, ''),")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') ws from documents),
d as (select n, unnest(ws) w from w),
b as (select unnest(regexp_extract_all({_LOW.replace('text,', "coalesce(text, ''),")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) w from benchmark),
x as (select w, hex(w) h from (select w from d union select w from b)),
y as (select w, list_transform(range(1, len(h), 2), lambda i: instr('0123456789ABCDEF', h[i]) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 17) bytes from x),
k as (select w, xor(list_reduce(bytes, lambda c, v: xor(c >> 8, crc[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) % 10000 b from y, tab),
s as (select b, count(*) s from d join k using (w) group by 1),
t as (select b, count(*) t from b join k using (w) group by 1),
g as (select b, floor(1000 * ln((coalesce(t, 0)::double + 1) * ((select count(*) from d) + 10000) / ((coalesce(s, 0)::double + 1) * ((select count(*) from b) + 10000))))::bigint g from s full join t using (b)),
e as (select n, sum(g)::bigint total from d join k using (w) join g using (b) group by 1),
f as (select doc_id, len(ws)::bigint n_features, coalesce(floor(total::double / len(ws)), 0)::bigint weight, ('0x' || sha256('2024:' || doc_id)[:8])::bigint h from w left join e using (n)),
r as (select doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))))::bigint score from f),
z as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) p, count(*) over (partition by n_features >= 20) many from r)
select doc_id, n_features, weight, score, case when n_features >= 20 and p <= 10 * many // 100 then p end as rank from z"""

OP13_SQL = """
with w as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws, min(doc_id) over (partition by coalesce(text, '')) first from documents),
m as (select part, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int mask,
  (doc_id in (select doc_id from labels where quality = 1))::int good, (doc_id in (select doc_id from labels where toxic = 1))::int toxic from w),
c as (select part, mask, count(*) n, sum(good) good, sum(toxic) toxic from m group by 1, 2),
k as (select unnest(range(5)) k),
p as (select [a.k, b.k, c.k, d.k, e.k] p from k a join k b on b.k <> a.k join k c on c.k not in (a.k, b.k) join k d on d.k not in (a.k, b.k, c.k) join k e on e.k not in (a.k, b.k, c.k, d.k)),
s as (select array_to_string(list_transform(p, lambda x: 'ABCDE'[x + 1]), '') filter_order, step, (1 << p[step])::int own, coalesce(list_sum(list_transform(p[:step - 1], lambda x: 1 << x)), 0)::int before from p, (select unnest(range(1, 6)) step)),
q as (select part, filter_order, step, own, sum(n) filter (where mask & (before | own) = 0) kept, sum(n) filter (where mask & before = 0 and mask & own > 0) removed,
  sum(n) filter (where mask & before > 0 and mask & own > 0) redundant, sum(n) filter (where mask = own) unique_fails,
  sum(good) filter (where mask & before = 0 and mask & own > 0) good_lost, sum(toxic) filter (where mask & before = 0 and mask & own > 0) toxic_lost from c, s group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, own))::bigint as shapley from q"""


def oracle_sql() -> dict[str, str]:
    found = {"op6_near_duplicates": OP6_SQL, "op8_decontaminate": OP8_SQL, "op12_importance": OP12_SQL, "op13_filter_audit": OP13_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
