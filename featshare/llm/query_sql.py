"""DuckDB SQL of the longer queries."""

from __future__ import annotations

from .pii import IBAN_LENGTHS, NEAR, THRESHOLD

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: crc32 bit by bit over a text's UTF-8 bytes
_CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(octet_length(encode(x))),
    lambda i: list_transform(range(8), lambda b: (('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::bigint >> b::bigint) & 1)))),
    lambda c, bit: case when xor(c, bit) & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295::bigint)"""

SPELLING_SQL = f"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]{{6,}}')) as w from documents),
once as (select doc_id, w, count(*) as c from runs group by all),
hashed as (select w, c, {_CRC} as h from (select w, c, coalesce(doc_id::varchar, '') || ':' || w as x from once)),
cut as (select case when h % 199 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, c
        from hashed),
words as (select word, sum(c)::bigint as n from cut where length(word) >= 6 group by word having sum(c) >= 5),
gaps as (select distinct word, n, i, left(word, i) || substr(word, i + 2) as rest
         from words, unnest(range(length(word))) t(i)),
pairs as (select a.word as a, a.n as n, b.word as b, b.n as m from gaps a join gaps b on a.rest = b.rest and a.i = b.i
          where a.word <> b.word
          union select a.word, a.n, b.word, b.n from gaps a join words b on a.rest = b.word
          union select b.word, b.n, a.word, a.n from gaps a join words b on a.rest = b.word),
ranked as (select a, n, b, m, count(*) over (partition by a) as n_near,
                  row_number() over (partition by a order by m desc, encode(b)) as k from pairs),
forms as (select a, n_near, case when m >= 5 * n then b end as form, case when m >= 5 * n then m end as form_n
          from ranked where k = 1),
chain as (select a as word, form as root from forms where form is not null
          union select chain.word, forms.form from chain join forms on chain.root = forms.a where forms.form is not null),
ends as (select word, root from chain where not exists (select 1 from forms where forms.a = chain.root and forms.form is not null))
select words.word, form, coalesce(root, words.word) as root, words.n, coalesce(n_near, 0) as n_near, form_n
from words left join forms on forms.a = words.word left join ends on ends.word = words.word"""


def _kind_sql(kind: str, order: int, pattern: str, check: str, worth: float, boost: float, context: str, base: bool) -> str:
    free = "" if base else "and not regexp_matches(before, '[0-9A-Za-z+.-]$') and not regexp_matches(after, '^-?[0-9A-Za-z]')"
    return f"""{kind}_t as (select r, regexp_extract_all(t, '{pattern}') as ms, regexp_split_to_array(t, '{pattern}') as ps from d
              where regexp_matches(t, '{pattern}')),
{kind}_l as (select r, ms, ps, list_transform(ms, lambda x: length(x)) as lm, list_transform(ps, lambda x: length(x)) as lp from {kind}_t),
{kind}_m as (select r, ms[i] as m, coalesce(list_sum(lp[1:i]), 0)::bigint + coalesce(list_sum(lm[1:i - 1]), 0)::bigint as a,
              right(ps[i], {NEAR}) as before, left(ps[i + 1], {NEAR}) as after
        from {kind}_l, unnest(range(1, len(ms) + 1)) u(i)),
{kind}_s as (select r, '{kind}' as kind, {order} as o, a, a + length(m) as b, {str(base).lower()} as base, {worth} + case when regexp_matches(
              translate(before || ' ' || after, '{_UPPER}', '{_LOWER}'), '(^|[^a-z])({context})([^a-z]|$)') then {boost} else 0 end as score
        from {kind}_m where {check} {free}),
"""


def pii_sql() -> str:
    """Base kinds by their plain patterns; added kinds where they pass the threshold and
    overlap no base span."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(length({digits})), lambda i: list_sum(list_transform(string_split(
        (substr(reverse({digits}), i + 1, 1)::int * (1 + i % 2))::varchar, ''), lambda x: x::int)))) % 10 = 0"""
    lengths = "case left(code, 2) " + " ".join(f"when '{c}' then {n}" for c, n in IBAN_LENGTHS.items()) + " else 0 end"
    mod97 = """list_reduce(list_concat([0], list_transform(string_split(substr(code, 5) || left(code, 4), ''),
        lambda c: case when c <= '9' then ascii(c) - 48 else ascii(c) - 55 end)),
        lambda r, v: (r * case when v < 10 then 10 else 100 end + v) % 97) = 1"""
    code = "replace(m, ' ', '')"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.9, 0.1, "e-?mail|mail|contact|write", True),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
         "list_max(list_transform(string_split(m, '.'), lambda x: x::hugeint)) <= 255", 0.6, 0.3, "ip|host|server|address|login", True),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) between 16 and 19 and {luhn}", 0.8, 0.2,
         "card|visa|mastercard|credit|payment|paid", True),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) between 8 and 15", 0.7, 0.3,
         "phone|tel|telephone|mobile|call|fax", True),
        ("iban", r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
         f"length({code}) = {lengths.replace('code', code)} and {mod97.replace('code', code)}", 0.8, 0.2,
         "iban|account|bank|konto|transfer", False),
        ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}",
         "m[1:3] not in ('000', '666') and m[1:1] <> '9' and m[5:6] <> '00' and m[8:11] <> '0000'", 0.4, 0.4,
         "ssn|social|security|taxpayer", False),
        ("tel", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "true", 0.4, 0.4, "phone|tel|telephone|mobile|call|fax", False),
    ]
    parts = "".join(_kind_sql(k, o, *rest) for o, (k, *rest) in enumerate(kinds))
    every = " union all ".join(f"select * from {k[0]}_s" for k in kinds)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
{parts}s as ({every}),
kept as (select r, kind, o, a, base, kind || ':' || a || ':' || b as span from s
         where base or (score >= {THRESHOLD} and not exists (select 1 from s x where x.r = s.r and x.base and x.a < s.b and s.a < x.b))),
g as (select r, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
             count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
             string_agg(span, ',' order by o, a) filter (base) as base, string_agg(span, ',' order by o, a) as spans
      from kept group by r)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card,
       coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (r)"""
