"""DuckDB SQL for the queries that SQL can express: the contract's rules and each method's definition, without its search structures."""

from foliospark.llm.license_scans import GATE, rules
from foliospark.llm.url_filters import REGISTRY, SHARED_SUFFIXES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
with seen as (select doc_id page_id, count(*) n, sum((coalesce(toxic,0)=1 or coalesce(quality,1)=0)::int) k from labels group by doc_id),
p as (select page_id, translate(coalesce(regexp_extract(url,'^.*?://([^/?#]*)',1,'s'),''),'{_UP}','{_LOW}') host, coalesce(regexp_extract(url,'^.*?://[^/?#]*([^?#]*)',1,'s'),'') path from pages),
h0 as (select host, coalesce(sum(n),0) n, coalesce(sum(k),0) k from p left join seen using (page_id) group by host),
h1 as (select *, regexp_replace(host,'^.*@|:[0-9]*$','','g') name from h0),
h2_ as (select *, string_split(name,'.') ls, array_to_string(string_split(name,'.')[-2:],'.') two from h1),
h3_ as (select *, case when regexp_matches(two,'^({REGISTRY})\.[a-z][a-z]$') or two in {SHARED_SUFFIXES} then two else ls[-1] end suffix from h2_),
h as (select host, n, k, suffix, case when regexp_matches(name,'^[0-9.]+$') then name when contains(suffix,'.') then array_to_string(ls[-3:],'.') else two end as domain from h3_),
d as (select suffix, domain, sum(n) n, sum(k) k from h group by suffix, domain),
s as (select suffix, sum(n) n, sum(k) k from d group by suffix),
s1 as (select *, (select coalesce(sum(k)/nullif(sum(n),0)::double,0) from s) m from s),
c0 as (select (1-r)/r c from (select greatest(0.001,least(0.5,coalesce(case when sum((n-1)*m*(1-m)) filter (n>0)>0 then sum((k-n*m)**2/n-m*(1-m)) filter (n>0)/sum((n-1)*m*(1-m)) filter (n>0) end,0.1))) r from s1)),
s2 as (select suffix, (k+c*m)/(n+c) m from s1, c0),
d1 as (select d.*, m from d join s2 using (suffix)),
c1 as (select (1-r)/r c from (select greatest(0.001,least(0.5,coalesce(case when sum((n-1)*m*(1-m)) filter (n>0)>0 then sum((k-n*m)**2/n-m*(1-m)) filter (n>0)/sum((n-1)*m*(1-m)) filter (n>0) end,0.1))) r from d1)),
d2 as (select suffix, domain, (k+c*m)/(n+c) m from d1, c1),
h2 as (select h.*, m from h join d2 using (suffix, domain)),
c2 as (select (1-r)/r c from (select greatest(0.001,least(0.5,coalesce(case when sum((n-1)*m*(1-m)) filter (n>0)>0 then sum((k-n*m)**2/n-m*(1-m)) filter (n>0)/sum((n-1)*m*(1-m)) filter (n>0) end,0.1))) r from h2)),
h3 as (select host, n, k, c, (k+c*m)/(n+c) m from h2, c2),
rep as (select host, n, k, sin(greatest(0,asin(sqrt(m))-1.645/(2*sqrt(n+c+1))))**2 b from h3),
size as (select host, count(*) pages from p group by host), corpus as (select sum(k)/nullif(sum(n),0)::double rate from rep),
worst as (select cast(floor(b*10000) as bigint) bin, sum(pages) pages from rep join size using (host), corpus where n>=3 and k>n*rate group by bin),
upto as (select bin, sum(pages) over (order by bin desc) pages from worst),
cut as (select min(bin) bin from upto where pages<=0.15*(select count(*) from p)),
rules(verdict, rule) as (values ('allow','org/'), ('block','example.org/es/'), ('block','example.org/en/1'), ('allow','com/fr/'), ('block','com/de/')),
r as (select verdict, rule, split_part(rule,'/',1) rh, rule[len(split_part(rule,'/',1))+1:] rp from rules),
u as (select distinct host, path from p),
fit as (select host, path, arg_max(rule,len(rule)) rule, arg_max(verdict,len(rule)) verdict from u join r on (host=rh or suffix(host,'.'||rh)) and starts_with(path,rp) group by host, path)
select page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, case when b>=0.5 or (n>=3 and k>n*rate and floor(b*10000)>=cut.bin) then 'block' else 'allow' end) verdict, cast(n as bigint) n_labelled, cast(k as bigint) n_bad, round(b,4) posterior_bound
from corpus, cut, p join rep on rep.host=p.host left join fit on fit.host=p.host and fit.path=p.path
"""

OP2 = """
with t as (select conv_id, turn, coalesce(role,'') as role, coalesce(text,'') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) i from conversations where conv_id is not null),
l as (select * from (select *, row_number() over (partition by conv_id order by turn desc nulls last, text desc) k from t where role='assistant') where k=1),
p as (select a.conv_id, b.conv_id rejected_conv, a.turn, a.text as text, b.text lent from l a join l b on b.conv_id=a.conv_id+1),
b as (select t.conv_id, rejected_conv, i, role, t.text as said, case when role='assistant' and t.turn is not distinct from p.turn and t.text=p.text then lent else t.text end other from t join p using (conv_id)),
n as (select conv_id, coalesce(min(case when said<>other then i end)-1, count(*)) n from b group by conv_id),
s as (select conv_id, rejected_conv, i, 0 side, role, said from b union all select conv_id, rejected_conv, i, 1, role, other from b),
shown as (select *, '<|'||role||'|>'||chr(10)||said||'<|end|>'||chr(10) line, (length(role)+5)||':0,'||length(said)||':'||(case when role='assistant' then 1 else 0 end)||',8:0' mask from s)
select conv_id pair_id, conv_id chosen_conv, rejected_conv, cast(n as bigint) n_common,
 coalesce(string_agg(line,'' order by i) filter (where side=0 and i<=n),'') prompt,
 coalesce(string_agg(line,'' order by i) filter (where side=0 and i>n),'') chosen, coalesce(string_agg(mask,',' order by i) filter (where side=0 and i>n),'') chosen_mask,
 coalesce(string_agg(line,'' order by i) filter (where side=1 and i>n),'') rejected, coalesce(string_agg(mask,',' order by i) filter (where side=1 and i>n),'') rejected_mask
from shown join n using (conv_id) group by conv_id, rejected_conv, n
"""

_SHINGLES = rf"""select {{id}}, unnest(case when len(w)<=5 then case when len(w)=0 then [] else [array_to_string(w,' ')] end else list_distinct(list_transform(range(1,len(w)-3), lambda i: array_to_string(w[i:i+4],' '))) end) s
 from (select {{id}}, regexp_extract_all(translate(coalesce(text,''),'{_UP}','{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from {{table}})"""
OP4 = f"""
with q as ({_SHINGLES.format(id="item_id", table="benchmark")}), d as ({_SHINGLES.format(id="doc_id", table="documents")}), size as (select item_id, count(*) n from q group by item_id)
select doc_id, q.item_id, count(*) n_shared, max(n) n_item, round(count(*)/max(n)::double,6) containment from d join q using (s) join size on size.item_id=q.item_id group by doc_id, q.item_id having count(*)>=0.8*max(n)
"""

OP5 = """
with p as (select page_id, octet_length(encode(coalesce(html,''))) n, sha256(coalesce(html,'')) d from pages),
f as (select *, min(page_id) over (partition by d) first from p)
select page_id, cast(n as bigint) payload_bytes, d payload_digest, case when n>=100 and page_id>first then 'revisit' else 'response' end record_type, case when n>=100 and page_id>first then first end refers_to from f
"""


def _rule_rows() -> str:
    """The rules with doubled spaces, so that neighbouring matches don't share one."""
    text = lambda v: "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({i},{text(a)},{text(f' {k} '.replace(' ', '  ')[1:-1])},{text(' (?:' + r.replace(' ', '  ') + ') ')},{p},{w})" for i, (a, k, r, p, w) in enumerate(rules()))


OP3 = rf"""
with w as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text,''),'{_UP}','{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
n as (select rid, ' '||array_to_string(ws,'  ')||' ' x from w where len(ws)>0 and regexp_matches(array_to_string(ws,' '), '{GATE}')),
r(ord, label, word, regex, priority, weight) as (values {_rule_rows()}),
h as (select rid, ord, label, priority, weight, x, regex from n join r on contains(x, word)),
u as (select rid, ord, label, priority, weight, unnest(regexp_extract_all(x,regex)) m, unnest(regexp_split_to_array(x,regex)[:-2]) g, unnest(range(len(regexp_extract_all(x,regex)))) i from h),
c as (select *, len(regexp_extract_all(m,'[^ ]+')) k, sum(len(regexp_extract_all(g,'[^ ]+'))+len(regexp_extract_all(m,'[^ ]+'))) over (partition by rid, ord order by i) e from u),
f as (select *, e-k s from c),
kept as (select * from f d where not exists (select 1 from f o where o.rid=d.rid and o.s<=d.s and o.e>=d.e and o.priority<=d.priority and (o.s,-o.e,o.priority,o.ord)<(d.s,-d.e,d.priority,d.ord))),
b as (select rid, count(*) n, cast(min(s) as bigint) a, cast(max(s) as bigint) z, string_agg(distinct label, ',' order by label) l from f where ord<3 group by rid),
k as (select rid, max(weight)::double score, count(*) nd from kept group by rid),
al as (select rid, string_agg(distinct label, ',' order by label) l from (select rid, label from kept union select rid, label from f where ord<3) group by rid)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(b.n,0) n_base, a first_word, z last_word, coalesce(b.l,'') base_labels, coalesce(al.l,'') labels, coalesce(score,0.0::double) score, coalesce(nd,0) n_detections
from w left join b using (rid) left join k using (rid) left join al using (rid)
"""


def _any_case(words: str) -> str:
    """A regex for ASCII letters in either case, as RE2's own flag folds beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SECRET, _ACCOUNT = _any_case("password|passwd|secret|token|api_?key"), _any_case("user(_?name)?|login|client_?id|account_?id").replace("(", "(?:")
#: Kind, regex (RE2 has no look-around, so a span is a group), groups of the span and of what is measured, least length, weak, role.
_PARTS = (
    ("assign", rf"""(({_SECRET})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 1, 3, 6, 0, "secret"),
    ("access", "(AKIA[A-Z0-9]+)", 1, 1, 20, 0, "account"),
    ("hex", "([0-9a-f]+)", 1, 1, 24, 0, "secret"),
    ("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\x20\x09-\x0D]*Proc-Type:[^\n]*)?(?:[\x20\x09-\x0D]*DEK-Info:[^\n]*)?[A-Za-z0-9+/=\x20\x09-\x0D]*(?:-----END [A-Z ]*PRIVATE KEY-----)?)", 1, 1, 1, 0, "secret"),
    ("account", rf"""((?:{_ACCOUNT})["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{{3,}})""", 1, 1, 3, 1, "account"),
    ("endpoint", r"""(?:^|[^A-Za-z0-9+.-])([A-Za-z][A-Za-z0-9+.-]{0,15}://[^\x20\x09-\x0D"'<>]+)""", 1, 1, 7, 1, "endpoint"),
)
#: Kind, runs of the characters that may not stand before a match, the match at a run's start, role.
_RUNS = (
    ("bare", "([A-Za-z0-9+/_=-]+)", "^[A-Za-z0-9+/_-]{32,}={0,2}", 0, "regexp_matches(h,'^[A-Za-z+/_-]*[0-9]') and regexp_matches(h,'^[0-9+/_-]*[A-Za-z]')", "secret"),
    ("address", "([0-9./@]+)", r"^((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:[/@]|\z)", 1, "true", "endpoint"),
)
_RANKS = {k: i for i, k in enumerate(("assign", "access", "hex", "private_key", "account", "bare", "endpoint", "address"))}


def _hits(regex: str, span: int, counted: int) -> str:
    """rid, h (the span), v (what is measured), e (its end): the pieces between matches and the matches are summed up."""
    said = regex.replace("'", "''")
    return f"""select rid, h, v, sum(len(g)+len(f)) over (partition by rid order by i) e from (select rid, unnest(regexp_extract_all(x,'{said}',0)) f, unnest(regexp_extract_all(x,'{said}',{span})) h, unnest(regexp_extract_all(x,'{said}',{counted})) v, unnest(regexp_split_to_array(x,'{said}')[:-2]) g, unnest(range(len(regexp_extract_all(x,'{said}',0)))) i from t)"""


_FOUND = [f"select rid, {_RANKS[kind]} rk, e-len(h) s, e, '{kind}' kind, {weak} weak, '{role}' as role from ({_hits(regex, span, counted)}) where len(v)>={least}" for kind, regex, span, counted, least, weak, role in _PARTS]
_FOUND += [f"select rid, {_RANKS[kind]} rk, e-len(h) s, e-len(h)+len(m) e, '{kind}' kind, 1 weak, '{role}' as role from (select *, regexp_extract(h,'{own}',{group}) m from ({_hits(run, 1, 1)})) where m<>'' and {more}" for kind, run, own, group, more, role in _RUNS]


OP8 = f"""
with t as (select row_number() over () rid, doc_id, coalesce(text,'') x from documents),
p as ({" union all ".join(_FOUND)}),
k as (select * from p where weak=0 union all select * from p w where weak=1 and exists (select 1 from p o where o.rid=w.rid and (case when w.role='account' then o.role='secret' else o.role<>w.role end) and (o.s between w.e and w.e+120 or o.e between w.s-120 and w.s))),
d as (select rid, count(*) filter (where rk=0) n_assign, count(*) filter (where rk=1) n_access, count(*) filter (where rk=2) n_hex,
 string_agg(kind||':'||s||':'||e, ',' order by s, rk) filter (where rk<3) base, string_agg(kind||':'||s||':'||e, ',' order by s, rk) spans from k group by rid)
select doc_id, coalesce(n_assign,0) n_assign, coalesce(n_access,0) n_access, coalesce(n_hex,0) n_hex, sha256(coalesce(base,'')) base_sha256, coalesce(spans,'') spans from t left join d using (rid)
"""

OP11 = rf"""
with w as (select doc_id, rid, unnest(ts) t, len(ts) n from (select doc_id, row_number() over () rid, regexp_extract_all(translate(coalesce(text,''),'{_UP}','{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ts from documents)),
g as (select count(distinct rid) n_docs, count(*) total from w),
q as (select iid, item_id, t, count(*) times from (select iid, item_id, unnest(regexp_extract_all(translate(coalesce(text,''),'{_UP}','{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) t from (select row_number() over () iid, item_id, text from (select distinct item_id, text from benchmark))) group by iid, item_id, t),
p as (select rid, any_value(doc_id) doc_id, t, any_value(n) n, count(*) tf from w where t in (select t from q) group by rid, t),
f as (select t, cast(floor(1000*ln((2*n_docs+2)/(2*count(*)+1)::double)) as bigint) weight from p, g group by t, n_docs),
s as (select iid, item_id, rid, any_value(doc_id) doc_id, cast(sum(times*weight*((1000000000*tf)//(1000*tf+12*(75+(25*n*n_docs)//total)))) as bigint) score from q join p using (t) join f using (t), g group by iid, item_id, rid),
r as (select *, row_number() over (partition by iid order by score desc, doc_id nulls last) as rank from s where score>0)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank<=20
"""

OP12 = rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text,'') x from documents),
l as (select rid, coalesce('i'||doc_id, 't'||md5(x)) doc, unnest(string_split(x,chr(10))) line, unnest(range(len(string_split(x,chr(10))))) i from d),
k as (select *, translate(regexp_replace(line,'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$','','g'),'{_UP}','{_LOW}') key from l),
c as (select key, true gone from k where length(key)>=1 group by key having count(distinct doc)>=10)
select any_value(d.doc_id) doc_id, count(*) n_lines, count(gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where gone is null),'')) kept_sha256 from k left join c using (key) join d using (rid) group by rid
"""

ORACLES: dict[str, str] = {"op1_url_filters": OP1, "op2_chat_formatting": OP2, "op4_benchmark_decontamination": OP4, "op3_license_scans": OP3, "op5_warc": OP5, "op8_secret_scans": OP8, "op11_ranked_search": OP11, "op12_line_dedup": OP12}
