"""SQL for DuckDB that gives the rows of the operators' queries, written against the tables alone."""

from __future__ import annotations

from . import url_filter
from .quality_rules import FEATURES, SCALE, Outliers
from .secret_scan import RULES

_WORDS = r"list_filter(string_split_regex({}, '[ \t-\r]+'), lambda z: z <> '')"
_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(patterns: list[tuple[str, str, str]]) -> str:
    """CTEs t and f: f has (doc_id, k, kind, hit, s, e) for (kind, pattern, condition on hit)."""
    each = " union all ".join(f"select doc_id, {k} as k, '{kind}' as kind, string_split_regex(x, {_quoted(p)}) as p, regexp_extract_all(x, {_quoted(p)}) as h from t" for k, (kind, p, _) in enumerate(patterns))
    keep = " ".join(f"when {k} then {c}" for k, (_, _, c) in enumerate(patterns))
    return f"""t as (select doc_id, coalesce(text, '') as x from documents), m as ({each}),
u as (select doc_id, k, kind, i, p[i] as piece, h[i] as hit from (select *, unnest(range(1, len(h) + 1)) as i from m)),
g as (select *, (sum(length(piece) + length(hit)) over (partition by doc_id, k order by i))::bigint as e from u),
f as (select doc_id, k, kind, hit, e - length(hit) as s, e from g where case k {keep} else true end)"""


def _digest(kinds: list[str], spans: str) -> str:
    counts = ", ".join(f"count(*) filter (f.kind = '{k}') as n_{k}" for k in kinds)
    joined = "string_agg(concat(f.kind, ':', f.s, ':', f.e), ',' order by f.s, f.k)"
    return f"select t.doc_id, {counts}, sha256(coalesce({joined} filter (f.k < {len(kinds)}), '')) as base_sha256, coalesce({joined} filter (f.k is not null), '') as spans from t left join {spans} f on f.doc_id = t.doc_id group by t.doc_id"


def op1_secret_scan() -> str:
    tests = [f"length(regexp_extract(hit, {_quoted(r.pattern)}, {r.group})) >= {r.least}" for r in RULES]
    return f"with {_spans([(r.kind, r.pattern, c) for r, c in zip(RULES, tests)])} {_digest(['assign', 'access', 'hex'], 'f')}"


def op3_pii() -> str:
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: case when i % 2 = 1 then reverse({digits})[i]::int when reverse({digits})[i]::int > 4 then 2 * reverse({digits})[i]::int - 9 else 2 * reverse({digits})[i]::int end)) % 10 = 0"
    ip = "len(list_filter(string_split(hit, '.'), lambda q: length(ltrim(q, '0')) > 3 or (length(ltrim(q, '0')) = 3 and ltrim(q, '0') > '255'))) = 0"
    base = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", ip),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) between 14 and 19 and {luhn}"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) between 10 and 15"),
        ("term", r"[\pL\pN]{4,}", "true"),
    ]
    return f"""with recursive {_spans(base)},
plain as (select doc_id, kind, case kind when 'email' then lower(hit) when 'ip' then hit else {digits} end as v from f where k < 4),
ent as (select distinct doc_id, md5(x) as key, unnest([concat(kind, ':', v), concat(kind, ':', case kind when 'email' then '@' || split_part(v, '@', -1) when 'ip' then concat(split_part(v, '.', 1), '.', split_part(v, '.', 2), '.*')
  when 'card' then v[1:6] || '*' else v[1:4] || '*' end), kind]) as e from plain join t using (doc_id)),
term as (select distinct doc_id, lower(hit) as w from f where k = 4),
often as (select w, count(*) as n_t from term group by 1), size as (select count(*) as n from t),
sk as (select key, list_sort(list_distinct(list(('0x' || substr(md5(w), 1, 15))::bigint)))[1:128] as h from (select distinct key, w from (select distinct doc_id, key from ent) join term using (doc_id)) group by 1 having count(*) >= 8),
lv as (select *, case when len(h) >= 64 then 16 when len(h) >= 32 then 8 when len(h) >= 16 then 4 when len(h) >= 8 then 2 else 1 end as m from sk),
bd as (select key, m, c, list_reduce(list_concat([0::bigint], list_filter(h, lambda z: z % m = c)), lambda a, b: xor(a, b)) as x
  from (select key, h, m from lv union select key, h, m // 2 from lv where m > 1), unnest(range(0, m)) u(c)),
tried as (select distinct bd.key, f.other from bd join (select m, c, x, min(key) as other from bd group by 1, 2, 3) f using (m, c, x) where bd.key <> f.other),
near as (select t.key, t.other, a.h as ah, b.h as bh, list_sort(list_distinct(list_concat(a.h, b.h)))[1:128] as u from tried t join sk a on a.key = t.key join sk b on b.key = t.other),
edge as (select key as p, other as q from near where 100 * len(list_intersect(list_intersect(u, ah), bh)) >= 80 * len(u)),
two as (select p, q from edge union select q, p from edge), reach as (select p, p as q from two union select r.p, e.q from reach r join two e on e.p = r.q),
grp as (select p as key, min(q) as g from reach group by 1),
entg as (select ent.*, coalesce(g, key) as grp from ent left join grp using (key)),
ents as (select e, count(*) as n_e from entg group by 1 having count(distinct grp) >= 3),
co as (select e, w, n_e, count(*) as n_et from entg join ents using (e) join term using (doc_id) group by 1, 2, 3 having count(distinct grp) >= 3),
told as (select w, max(ln(n * n_et / (n_e * n_t)) / ln(n / n_e)) as strength from co join often using (w), size where n_e < n group by 1),
tell as (select doc_id, w, strength from told join term using (w) where strength >= 0.75),
add_ as (select f.doc_id, f.k, case when strength >= 0.95 then 'term' else 'class' end as kind, f.s, f.e from f join tell on tell.doc_id = f.doc_id and tell.w = lower(f.hit)
  where f.k = 4 and not exists (select 1 from f b where b.doc_id = f.doc_id and b.k < 4 and b.s < f.e and f.s < b.e)),
every as (select doc_id, k, kind, s, e from f where k < 4 union all select * from add_) {_digest(['email', 'ip', 'card', 'phone'], 'every')}"""


def op4_quality_rules() -> str:
    rule, d, scale = Outliers(), range(len(FEATURES)), SCALE
    ridge = (rule.floor * scale) ** 2
    m, low = [f"m{i}" for i in d], [f"l{i}{j}" for i in d for j in range(i + 1)]

    def distance(est: str) -> str:
        z = []
        for i in d:
            rest = f"x{i} - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(i))
            z.append(f"({rest}) / l{i}{i} as z{i}")
        return f"select r.*, s, {', '.join(z)}, {' + '.join(f'z{i} * z{i}' for i in d)} as d2 from r join {est} using (g) where n_words > 0"

    def chol(cov, least: float, scaled: str = "") -> str:
        """l_ij by name, or k_ij first and l_ij = k_ij times the scale of row i."""
        name, out = ("k" if scaled else "l"), []
        for i in d:
            for j in range(i + 1):
                rest = cov(i, j) + "".join(f" - {name}{i}{k} * {name}{j}{k}" for k in range(j))
                out.append(f"sqrt(greatest({rest}, {least})) as {name}{i}{j}" if i == j else f"({rest}) / {name}{j}{j} as {name}{i}{j}")
        return ", ".join(out + ([f"k{i}{j} * {scaled}{i} as l{i}{j}" for i in d for j in range(i + 1)] if scaled else []))

    step_cov = lambda i, j: f"(p{i}{j} / n - m{i} * m{j}) * {rule.consistency} + {ridge if i == j else 0.0}"
    steps = ""
    for k in range(rule.steps):
        sums = ", ".join([f"sum(x{i})::double as s{i}" for i in d] + [f"sum(x{i}::hugeint * x{j})::double as p{i}{j}" for i in d for j in range(i + 1)])
        steps += f"""near{k} as (select *, floor(ln(1 + d2) * 256)::int as bin from ({distance(f"est{k}")})),
cum{k} as (select *, sum(n) over (partition by g, s order by bin) as c, sum(n) over (partition by g, s) as a from (select g, s, bin, count(*) as n from near{k} group by 1, 2, 3)),
lim{k} as (select g, s, min(bin) as top from cum{k} where c >= ceil(a * {rule.keep}) group by 1, 2),
sum{k} as (select g, s, count(*)::double as n, {sums} from near{k} join lim{k} using (g, s) where bin <= top group by 1, 2),
est{k + 1} as (select g, s, {', '.join(m + low)} from (select *, {', '.join(f's{i} / n as m{i}' for i in d)}, {chol(step_cov, ridge / 4)} from sum{k})),
"""
    median = "select g, j, min(v) as mid from (select *, sum(n) over (partition by g, j order by v) as c, sum(n) over (partition by g, j) as a from (select g, j, v, count(*) as n from {} group by 1, 2, 3)) where 2 * c >= a group by 1, 2"
    middle = [f"max(case when j = {i} then mid end)::double as m{i}" for i in d] + [f"greatest(max(case when j = {i} then mad end) * 1.4826, {rule.floor * scale}) as c{i}" for i in d]
    moments = ", ".join(f"sum({n}{i} * {n}{j})::double as {n}{i}{j}" for n in "ab" for i in d for j in range(i + 1))
    start = lambda n: lambda i, j: (f"{n}{i}{j} / n / {float(scale * scale)}" if n else ("1.0" if i == j else "0.0")) + f" + {rule.blur if i == j else 0.0}"
    starts = " union all ".join(f"select g, {s} as s, {', '.join(m + low)} from (select *, {chol(start(n), rule.blur / 4, 'c')} from mom join cen using (g))" for s, n in enumerate(("", "a", "b")))
    return f"""with t as (select doc_id, lang, source, coalesce(text, '') as x from documents),
w as (select *, {_WORDS.format("x")} as w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^ \t-\r]')) as lines from t),
win as (select doc_id, i, array_to_string(w[i : i + 4], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) > 5)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, k) > 1),
cov as (select doc_id, sum(c)::bigint as c from (select doc_id, least(5, coalesce(lead(i) over (partition by doc_id order by i) - i, 5)) as c from rep) group by 1),
b as (select doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c, 0) as n_repeat_words from w left join cov using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, greatest(n_words, 1) as nz, round(ln(1 + n_words) * {scale})::bigint as x0, round(ln(1 + word_chars / nz) * {scale})::bigint as x1,
  round(ln(1 + 100 * n_symbols / greatest(word_chars, 1)) * {scale})::bigint as x2, round(4 * n_dup_lines / greatest(n_lines, 1) * {scale})::bigint as x3, round(4 * n_repeat_words / nz * {scale})::bigint as x4 from b),
own as (select *, sum(case when n < {rule.least} then n else 0 end) over (partition by lang) as many from (select lang, source, count(*) as n from f group by 1, 2)),
grp as (select lang, source, case when n >= {rule.least} then concat(coalesce('=' || lang, '-'), '|', coalesce('=' || source, '-')) when many >= {rule.least} then coalesce('=' || lang, '-') else '*' end as g from own),
r as (select f.*, g from f join grp on f.lang is not distinct from grp.lang and f.source is not distinct from grp.source),
long as (select g, unnest(range({len(FEATURES)})) as j, unnest([x0, x1, x2, x3, x4]) as v from r where n_words > 0),
mid as ({median.format("long")}), away as (select long.g, long.j, abs(v - mid) as v from long join mid using (g, j)),
mad as (select g, j, mid as mad from ({median.format("away")})),
cen as (select g, {', '.join(middle)} from mid join mad using (g, j) group by g),
zed as (select g, {', '.join(f'(x{i} - m{i}) / c{i} as z{i}' for i in d)}, sqrt({' + '.join(f'z{i} * z{i}' for i in d)}) as len from r join cen using (g) where n_words > 0),
tra as (select g, {', '.join(f'round(z{i} / (1 + abs(z{i})) * {scale})::bigint as a{i}' for i in d)}, {', '.join(f'round(case when len > 0 then z{i} / len else 0.0 end * {scale})::bigint as b{i}' for i in d)} from zed),
mom as (select g, count(*)::double as n, {moments} from tra group by g),
est0 as ({starts}),
{steps}best as (select * from est{rule.steps} qualify row_number() over (partition by g order by {' + '.join(f'ln(l{i}{i})' for i in d)}, s) = 1),
far as ({distance("best")})
select r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, not r.base_failed and coalesce(far.d2, 0) <= {rule.cutoff} as kept from r left join far using (doc_id)"""


def op5_jaccard_join() -> str:
    return f"""with recursive w as (select doc_id, {_WORDS.format(_AZ)} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) end as sh from w),
node as (select list_sort(sh) as sh, min(doc_id) as rep from s where len(sh) > 0 group by 1),
tok as (select rep, len(sh) as n, unnest(sh) as x from node), df as (select x, count(*) as c from tok group by 1),
pre as (select rep, n, x from tok join df using (x) qualify row_number() over (partition by rep order by c, x) <= n - ceil(0.9 * n) + 2),
cand as (select distinct a.rep as a, b.rep as b from pre a join pre b on a.x = b.x and a.rep < b.rep and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
link as (select a, b from cand join node p on p.rep = a join node q on q.rep = b where 100 * len(list_intersect(p.sh, q.sh)) >= 90 * (len(p.sh) + len(q.sh) - len(list_intersect(p.sh, q.sh)))),
both_ as (select a, b from link union all select b, a from link),
reach(a, b) as (select rep, rep from node union select reach.a, both_.b from reach join both_ on reach.b = both_.a),
comp as (select a as rep, min(b) as c from reach group by 1)
select s.doc_id, len(s.sh) as n_shingles, coalesce(comp.c, s.doc_id) as component_id from s left join node on node.sh = list_sort(s.sh) and len(s.sh) > 0 left join comp on comp.rep = node.rep"""


def op6_url_filter() -> str:
    def regex(glob: str) -> str:
        out, i = "(?s)", 0
        while i < len(glob):
            if glob[i : i + 2] == "**":
                out, i = out + ".*", i + 2
            else:
                out, i = out + {"*": "[^/]*", "?": "."}.get(glob[i], "\\" + glob[i] if not glob[i].isalnum() else glob[i]), i + 1
        return out

    rules = sorted(url_filter.BASE, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in rules)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in rules)
    other = " or ".join(f"regexp_full_match(host || path, {_quoted(regex(g))})" for g in url_filter.GLOBS)
    return f"""with a as (select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as r from pages),
b as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from a)
select page_id, host, path, case {rule} end as rule, case {verdict} when {other} then 'block' else 'allow' end as verdict from b"""


def op7_hamming_topk() -> str:
    return """with v as (select vec_id, list_transform(embedding, lambda x: x > 0) as c from embeddings),
d as (select q.vec_id, v.vec_id as neighbour, len(list_filter(list_zip(q.c, v.c), lambda z: z[1] <> z[2])) as distance from v q join v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id)
select vec_id, row_number() over (partition by vec_id order by distance, neighbour) as "rank", neighbour, distance from d qualify "rank" <= 10"""


def op10_mixing() -> str:
    return f"""with d as (select doc_id, source, len({_WORDS.format("coalesce(text, '')")}) as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
w as (select *, 2 * source_size as cap, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from s),
p as (select *, sum(source_size) over () * 3 as total, sum(w) over () as w_all, row_number() over (order by cap / w, source nulls last) as nth,
  coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
  coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as w_capped from w),
l as (select *, (total - 2 * capped)::double / (2 * (w_all - w_capped))::double as level from p),
x as (select level from l where w * level <= cap order by nth limit 1),
t as (select l.source, l.source_size, least(l.cap::double, coalesce(l.w * x.level, l.cap::double)) as target from l left join x on true),
r as (select d.*, t.source_size, t.target, case when t.source_size > 0 then least(t.target / t.source_size, 2.0) else 0.0 end as rate,
  row_number() over (partition by d.source order by d.size, md5(d.doc_id::varchar)) as rnk,
  ('0x' || substr(md5(concat('7:', coalesce(d.source, chr(0)))), 1, 8))::bigint::double / 4294967296.0 as u from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (least(floor(rate * rnk + u) - floor(rate * (rnk - 1) + u), 2)::bigint * size)::bigint as taken from r"""


_RUNS = rf"regexp_extract_all({_AZ}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
#: CTE crc_tab: the 256 entries of CRC-32's table as one list.
_CRC_TAB = "crc_tab as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as tab from range(256) r(i))"


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes, where crc_tab's `tab` is at hand."""
    raw = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {raw}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def op11_decontaminate() -> str:
    return f"""with d as (select doc_id, {_RUNS} as w from documents),
b as (select item_id::varchar as item, {_RUNS} as w from benchmark where item_id is not null),
win as (select distinct item, least(len(w), 10) as t, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as x from b, unnest(range(1, len(w) - least(len(w), 10) + 2)) u(i) where len(w) > 0),
pl as (select doc_id, t, i, array_to_string(w[i:i + t - 1], ' ') as x from d, (select distinct t from win) l, unnest(range(1, len(w) - t + 2)) u(i)),
hit as (select pl.* from pl semi join win using (t, x)),
n as (select doc_id, count(distinct i + j) as n_hit from hit, unnest(range(0, t)) u(j) group by 1),
its as (select doc_id, list_sort(list(distinct item)) as items from hit join win using (t, x) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(items), 0) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, n_hit is not null as contaminated
from d left join n using (doc_id) left join its using (doc_id)"""


def op12_resample() -> str:
    return f"""with {_CRC_TAB}, d as (select doc_id, {_RUNS} as w from documents), g as (select {_RUNS} as w from benchmark),
dw as (select doc_id, unnest(w) as x from d), gw as (select unnest(w) as x from g),
v as (select x, ({_crc("x")}) % 10000 as bucket from (select x from dw union select x from gw), crc_tab),
s as (select bucket, count(*) as s from dw join v using (x) group by 1), t as (select bucket, count(*) as t from gw join v using (x) group by 1),
n as (select (select count(*) from dw) as s_all, (select count(*) from gw) as t_all),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double)))::bigint as gain from s left join t using (bucket), n),
own as (select doc_id, floor(sum(gain)::double / count(*))::bigint as weight from dw join v using (x) join gain using (bucket) group by 1),
r as (select d.doc_id, len(w) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || d.doc_id::varchar), 1, 8))::bigint as h from d left join own using (doc_id)),
sc as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double)))::bigint as score from r),
o as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as nth, (count(*) over (partition by n_features >= 20)) * 10 // 100 as drawn from sc)
select doc_id, n_features, weight, score, case when n_features >= 20 and nth <= drawn then nth end as "rank" from o"""


def op13_conversation_trie() -> str:
    return f"""with {_CRC_TAB}, o as (select conv_id as c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} order by turn nulls first) as l from conversations where conv_id is not null group by 1),
h as (select o.*, ({_crc("c::varchar")}) % 4 as h from o, crc_tab),
rb as (select h.c, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:len(h.l)]) as p from h left join o b on b.c = h.c - h.c % 20),
pl as (select c, d, len(p) = d as ends, md5(p[1:d]::varchar) as k, p[d].x as x from rb, unnest(range(0, len(p) + 1)) u(d)),
node as (select d, k, min(c) as conv_id, count(*) as n_convs, case when d = 0 then 0 else len({_WORDS.format("any_value(x)")}) end as w,
  sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) as ends_sha256 from pl group by 1, 2),
up as (select md5(p[1:d]::varchar) as k, d, md5(p[1:e]::varchar) as a, e from (select distinct p, unnest(range(0, len(p) + 1)) as d from rb), unnest(range(0, d + 1)) u(e)),
pair as (select distinct k, d, a, e from up),
sums as (select e as d, a as k, count(*) filter (where pair.d = e + 1) as n_children, sum((n_convs - 1) * w)::bigint as saved_tokens,
  count(*) filter (where not exists (select 1 from pair q where q.e = pair.d and q.a = pair.k and q.d > q.e)) as n_leaves from pair join node on node.d = pair.d and node.k = pair.k group by 1, 2)
select node.conv_id, node.d as depth, par.conv_id as parent_conv_id, node.n_convs, n_children, n_leaves, saved_tokens, node.ends_sha256
from node join sums using (d, k) left join pair on pair.d = node.d and pair.k = node.k and pair.e = node.d - 1 left join node par on par.d = pair.e and par.k = pair.a"""


def oracle_sql() -> dict[str, str]:
    own = (op1_secret_scan, op3_pii, op4_quality_rules, op5_jaccard_join, op6_url_filter, op7_hamming_topk, op10_mixing, op11_decontaminate, op12_resample, op13_conversation_trie)
    return {f.__name__: f() for f in own}
