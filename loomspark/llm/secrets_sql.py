"""The SQL twin of the query for secrets: plain patterns, and the entropy of every window counted anew."""

from __future__ import annotations

from loomspark.llm.pii_sql import spans


def either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# fixed values: the base patterns as stated; a run of 24 or more is a run that is long enough
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
PATTERNS = {
    "assign": f"({'|'.join(map(either, KEYWORDS))})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
}
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Classes with the bits a character that a window must reach.
CLASSES = {"[0-9a-fA-F]{20,}": 3.0, "[A-Za-z0-9]{20,}": 3.7, "[A-Za-z0-9+/_=-]{20,}": 3.9}
ALLOWED = ("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "sha(?:256|384|512)-[A-Za-z0-9+/=]+")
KNOWN = "(?i)example|abcdefghij|0123456789"


def query(window: int = 20) -> str:
    keep = {"assign": f"length(regexp_extract(y.v, '{PATTERNS['assign']}', 2)) >= 6", "access": "length(y.v) >= 20", "hex": "true"}
    base = ", ".join(f"list_filter({spans('text', p)}, lambda y: {keep[k]}) as {k}" for k, p in PATTERNS.items())
    flat = " union all ".join(f"select doc_id, {i} as n, '{k}' as kind, x.s as s, x.e as e from b, unnest({k}) u(x)" for i, k in enumerate(PATTERNS))
    runs = " union all ".join(f"select doc_id, c, v, {i} as class, {t}::double as least, unnest({spans('v', p)}) as r from cand" for i, (p, t) in enumerate(CLASSES.items()))
    known = " or ".join(f"len(list_filter({spans('v', p)}, lambda y: y.s <= a and b <= y.e)) > 0" for p in ALLOWED)
    count = "len(list_filter(w, lambda q: q = p))"
    return f"""with d as (select doc_id, coalesce(text, '') as text from documents),
b as (select doc_id, {base} from d),
flat as ({flat}),
cand as (select doc_id, x.s as c, x.v as v from (select doc_id, {spans('text', CANDIDATE)} as xs from d), unnest(xs) u(x)),
runs as ({runs}),
windows as (select doc_id, c, v, class, least, r.s as run, r.s + i as a, string_split(substr(r.v, i + 1, {window}), '') as w from (select *, unnest(range(0, length(r.v) - {window} + 1)) as i from runs)),
hot as (select doc_id, c, v, class, run, a from windows
  where list_sum(list_transform(list_distinct(w), lambda p: {count} * log2({count}))) <= {window} * (log2({window}) - least) + 1e-9
    and len(list_filter(w, lambda p: p between '0' and '9')) between 1 and {window - 1}
    and len(list_filter({spans('v', KNOWN)}, lambda y: y.s < a + {window} and a < y.e)) = 0),
marked as (select *, case when a - lag(a) over (partition by doc_id, c, class, run order by a) <= {window} then 0 else 1 end as fresh from hot),
joined as (select *, sum(fresh) over (partition by doc_id, c, class, run order by a) as k from marked),
own as (select doc_id, c, v, min(a) as a, max(a) + {window} as b from joined group by doc_id, c, v, class, run, k),
open as (select doc_id, c + a as s, c + b as e, c from own where not ({known})),
again as (select *, case when s <= max(e) over (partition by doc_id, c order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from open),
numbered as (select *, sum(fresh) over (partition by doc_id, c order by s, e) as k from again),
found as (select doc_id, min(s) as s, max(e) as e from numbered group by doc_id, c, k),
more as (select * from found f where not exists (select 1 from flat x where x.doc_id = f.doc_id and x.s <= f.s and x.e >= f.e)),
every as (select * from flat union all select doc_id, {len(PATTERNS)}, 'entropy', s, e from more),
told as (select doc_id, count(*) filter (kind = 'entropy') as n_entropy, string_agg(kind || ':' || s || ':' || e, ',' order by s, n) filter (kind <> 'entropy') as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, n) as spans from every group by doc_id)
select doc_id, {', '.join(f'cast(len({k}) as bigint) as n_{k}' for k in PATTERNS)}, coalesce(n_entropy, 0) as n_entropy, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from b left join told using (doc_id)"""
