"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"""regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"""

_CAPITALS = "".join(map(chr, range(ord("A"), ord("Z") + 1)))


def _leaf(text: str) -> str:
    said = lambda x: f"case when {x} is null then '-' else strlen({x}::varchar) || ':' || {x}::varchar end"
    return f"sha256({' || '.join(said(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


SQL = {
    "op2_substring_dedup": rf"""
with doc as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
word as (select r, unnest(w) as x, generate_subscripts(w, 1) as i from doc),
win as (select r, i, array_to_string(list_slice(w, i, i + 34), ' ') as k
        from (select r, w, unnest(range(1, len(w) - 33)) as i from doc where len(w) >= 35)),
hit as (select r, i from win where k in (select k from win group by k having count(*) > 1)),
edge as (select r, i, sum(d) as d from (select r, i, 1 as d from hit union all select r, i + 35, -1 from hit) group by r, i),
cover as (select word.r, word.i, word.x, sum(coalesce(d, 0)) over (partition by word.r order by word.i) as c
          from word left join edge on edge.r = word.r and edge.i = word.i),
kept as (select r, string_agg(x, ' ' order by i) filter (where c = 0) as t, count(*) filter (where c > 0) as gone from cover group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(gone, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from doc left join kept using (r)""",
    "op5_mixing": rf"""
with d as (select doc_id, source, cast(len({_WORDS}) as bigint) as size, 
             cast('0x' || substr(md5('11:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as ord from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as turn from d group by source),
w as (select *, case turn % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, source_size * 2.0::double as cap from s),
f as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as fill
      from w window before as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
c as (select *, cap <= w * fill as clamped from f),
o as (select *, first_value(case when not clamped then fill end) over (order by clamped, cap / w, source nulls last) as level from c),
t as (select source, source_size, case when clamped or level is null then cap else least(cap, w * level) end as target from o),
p as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as times from t),
q as (select *, cast(floor(target + 0.5) as bigint) - times * source_size as rest from p),
b as (select *, sum(size) over (partition by source order by ord) as upto, sum(size) over (partition by source, ord) as here, count(*) over (partition by source, ord) as alike from d)
select b.doc_id, b.size, q.source_size, q.target,
  cast(q.times * b.size + case when upto <= q.rest then b.size when upto - here >= q.rest then 0 else least(b.size, (q.rest - upto + here) // alike) end as bigint) as taken
from b join q on b.source is not distinct from q.source""",
    "op9_quality_rules": rf"""
with doc as (select row_number() over () as r, doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
win as (select r, i, array_to_string(list_slice(w, i, i + 4), ' ') as k
        from (select r, w, unnest(range(1, len(w) - 3)) as i from doc where len(w) >= 5)),
rep as (select r, i from (select r, i, count(*) over (partition by r, k) as n from win) where n > 1),
covered as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from rep) group by r),
line as (select r, unnest(string_split(t, chr(10))) as l from doc),
wordy as (select r, count(*) as lines, count(*) - count(distinct l) as dup from line where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
c as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
        coalesce(dup, 0) as n_dup_lines, coalesce(lines, 0) as lines, coalesce(n, 0) as n_repeat_words,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as upper,
        length(t) - length(regexp_replace(t, '[A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) as letters
      from doc left join covered using (r) left join wordy using (r)),
j as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not (base_failed or n_symbols > 0.2 * n_words or upper > 0.6 * letters or (lines >= 4 and n_dup_lines > 0.5 * lines)
       or word_chars < 2 * n_words or word_chars > 14 * n_words or letters < 0.4 * word_chars) as kept
from j""",
    "op10_chat_format": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as x from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, lag(role) over o as last,
        regexp_replace(regexp_replace(regexp_replace(x, '%(25|3C|5B|0A)', '%25\1', 'g'),
          '<(\|begin\|>|\|im_start\|>|\|turn\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>)', '%3C\1', 'g'),
          '\[(INST\]|/INST\])', '%5B\1', 'g') as esc
      from t window o as (partition by conv_id order by turn, role, x))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || x || chr(10), '' order by turn, role, x)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(x) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(x, '' order by turn, role, x) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(length('<|begin|>') + sum(length(esc) + case when last = role then length('<|turn|>')
    else length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1 end) as bigint) as formatted_chars
from e group by conv_id""",
    "op12_merkle_manifest": rf"""
with recursive
crc as (select range as n, 0 as k, range as v from range(256)
        union all select n, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from crc where k < 8),
remainders as (select list(v order by n) as t from crc where k = 8),
crced as (select documents.*, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda c: ascii(c)::bigint)),
            lambda c, x: case when x = 0 then c else xor(c >> 8, t[(xor(c, x) & 255) + 1]) end)) % 3 = 0 as changes from documents, remainders),
leaf as (select row_number() over () as r, doc_id, lang, coalesce('=' || lang, '-') as k, {_leaf("text")} as leaf,
           case when changes then {_leaf(f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')")} end as changed from crced),
placed as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by k) as n from leaf),
up as (select k, 0 as l, pos, n, leaf as h from placed
       union all select k, l + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from up where n > 1 group by k, l, pos // 8, n),
subroot as (select k, l, h, row_number() over (order by k <> '-', k) - 1 as pos, count(*) over () as n from up where n = 1),
top as (select 0 as l, pos, n, h from subroot
        union all select l + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by l, pos // 8, n),
node as (select k, l, pos, n, h from up union all select '*', l, pos, n, h from top),
side as (select k, l, pos,
           coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
           coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as after
         from node where n > 1 window w as (partition by k, l, pos // 8 order by pos)),
walk as (select r, k as own, k, 0 as l, pos, '' as proof, coalesce(changed, leaf) as h from placed
         union all select r, own, walk.k, walk.l + 1, walk.pos // 8, proof || before || after, sha256(before || h || after)
                   from walk join side on side.k = walk.k and side.l = walk.l and side.pos = walk.pos),
lang_walk as (select r, own, '*' as k, 0 as l, subroot.pos, proof, walk.h from walk join subroot on subroot.k = walk.own and subroot.l = walk.l
              union all select r, own, '*', w.l + 1, w.pos // 8, proof || before || after, sha256(before || h || after)
                        from lang_walk w join side on side.k = '*' and side.l = w.l and side.pos = w.pos),
root as (select l, h from top where n = 1)
select placed.doc_id, placed.leaf, subroot.h as subroot, root.h as root, sha256(w.proof) as proof_sha256, w.h as folded_root, w.h = root.h as verified
from placed join subroot using (k) join lang_walk w using (r) join root on root.l = w.l""",
    "op13_exact_dedup": r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as c from documents),
g as (select *, count(*) over (partition by c) as n, first_value(doc_id) over w as keep, first_value(length(t)) over w as longest
      from d window w as (partition by c order by length(t) desc, doc_id nulls last))
select doc_id, keep as keep_id, n as group_size, doc_id is not distinct from keep and length(t) = longest as kept, sha256(c) as text_sha256 from g""",
}
