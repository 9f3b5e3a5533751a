"""The SQL twin of the query for personal data: plain patterns, the same statistics."""

from __future__ import annotations

# fixed values: the base patterns as stated
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
def spans(text: str, pattern: str) -> str:
    """A list of (s, e, v): matches and the pieces between them add up to offsets."""
    m, p = f"regexp_extract_all({text}, '{pattern}')", f"regexp_split_to_array({text}, '{pattern}')"
    before = f"cast(coalesce(list_sum(list_transform(({p})[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(({m})[1:i - 1], lambda x: length(x))), 0) as bigint)"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': {before}, 'e': {before} + length(({m})[i]), 'v': ({m})[i]}})"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn(d: str) -> str:
    one = f"cast(({d})[length({d}) - i] as int)"
    return f"list_sum(list_transform(range(0, length({d})), lambda i: case when i % 2 = 0 then {one} when {one} > 4 then 2 * {one} - 9 else 2 * {one} end)) % 10 = 0"


KEEP = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(y.v, '.'), lambda q: case when length(ltrim(q, '0')) > 3 then false else cast('0' || ltrim(q, '0') as int) <= 255 end))",
    "card": f"case when length({digits('y.v')}) between 13 and 19 then {luhn(digits('y.v'))} else false end",
    "phone": f"length({digits('y.v')}) between 9 and 15",
}
ENTITY = {"email": "lower(x.v)", "ip": "x.v", "card": digits("x.v"), "phone": digits("x.v")}


def query(support: int = 2, share: float = 0.8) -> str:
    found = ", ".join(f"list_filter({spans('text', p)}, lambda y: {KEEP[k]}) as {k}" for k, p in PATTERNS.items())
    entities = " union ".join(f"select doc_id, '{k}:' || {ENTITY[k]} as entity from b, unnest({k}) u(x)" for k in PATTERNS)
    shown = lambda k: f"list_transform({k}, lambda x: '{k}:' || x.s || ':' || x.e)"
    base = "list_concat(list_concat({}, {}), list_concat({}, {}))".format(*[shown(k) for k in PATTERNS])
    marks = "list_concat(list_concat({}, {}), list_concat({}, {}))".format(*PATTERNS)
    counts = ", ".join(f"cast(len({k}) as bigint) as n_{k}" for k in PATTERNS)
    return rf"""with d as (select doc_id, coalesce(text, '') as text from documents),
b as (select doc_id, text, {found} from d),
o as (select doc_id, case when len({marks}) = 0 then text else array_to_string(list_transform(string_split(text, ''), lambda c, i: case when len(list_filter({marks}, lambda m: m.s < i and i <= m.e)) > 0 then ' ' else c end), '') end as said from b),
g as (select doc_id, unnest(regexp_extract_all(said, '\p{{L}}+')) as v, unnest(regexp_split_to_array(said, '\p{{L}}+')) as gap, unnest(range(len(regexp_extract_all(said, '\p{{L}}+')) + 1)) as i from o),
w as (select doc_id, v, sum(length(gap) + length(v)) over (partition by doc_id order by i) as e from g where v is not null),
t as (select doc_id, case when length(v) >= 4 then lower(v) else v end as term, cast(e - length(v) as bigint) as s, cast(e as bigint) as e from w where length(v) >= 4 or regexp_matches(v, '^[\p{{Lu}}\p{{Lt}}\p{{Lo}}]')),
once as (select distinct doc_id, term from t),
dfs as (select term, count(*) as df from once group by 1),
mentions as ({entities}),
ents as (select entity, count(*) as ce from mentions group by 1 having count(*) >= {support}),
pairs as (select entity, term, count(*) as cte from mentions join ents using (entity) join once using (doc_id) group by 1, 2 having count(*) >= {support}),
n as (select count(*)::double as n from d),
good as (select distinct term from pairs join ents using (entity) join dfs using (term), n where n / ce > 1 and ln(cte * n / (df * ce)) / ln(n / ce) >= {share}),
terms as (select doc_id, list_sort(list({{'s': s, 'e': e}})) as term from t join good using (term) group by 1)
select doc_id, {counts}, cast(coalesce(len(term), 0) as bigint) as n_term, sha256(array_to_string({base}, ',')) as base_sha256,
  array_to_string(list_concat({base}, coalesce({shown('term')}, [])), ',') as spans
from b left join terms using (doc_id)"""
