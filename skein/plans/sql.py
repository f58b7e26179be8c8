"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from skein.functions import speech as V
from skein.rules import SYNTHETIC as P


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]" if values else "[]::varchar[]"


STOP = quoted(P.stopwords)


def tok(col: str, stop: str = STOP) -> str:
    return f"list_filter(list_transform(regexp_extract_all({col}, '[a-zA-Zа-яА-Я0-9_]+'), lambda x: lower(x)), lambda x: length(x) > 1 and not list_contains({stop}, x))"


def expanded(tokens: str) -> str:
    """The tokens with their stems' extra tokens."""
    cases = ", ".join(f"case when starts_with(t, '{stem}') then {quoted(more)} else []::varchar[] end" for stem, more in P.expansions.items())
    return f"list_concat({tokens}, flatten(list_transform({tokens}, lambda t: flatten([{cases}]))))"


def estimate(col: str) -> str:
    return f"greatest(1, len(regexp_extract_all({col}, '[A-Za-zА-Яа-яЁё0-9_]+')))"


def has(col: str, markers) -> str:
    return "(" + " or ".join(f"contains({col}, '{m}')" for m in markers) + ")" if markers else "false"


def count(col: str, markers) -> str:
    return "(" + " + ".join(f"contains({col}, '{m}')::int" for m in markers) + ")" if markers else "0"


PART = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def path(url: str) -> str:
    bare = f"regexp_replace(regexp_extract({url}, '{PART}', 3), '/+$', '')"
    return f"case when {bare} = '' then '/' else {bare} end"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '{PART}', 2))"


def canonical(url: str) -> str:
    seg = f"list_filter(string_split(regexp_extract({url}, '{PART}', 3), '/'), lambda s: s not in ('', 'm', 'c'))"
    once = f"list_filter({seg}, lambda s, i: i = 1 or s <> ({seg})[i - 1])"
    return f"case when lower(regexp_extract({url}, '{PART}', 1)) in ('http', 'https') then lower(regexp_extract({url}, '{PART}', 1)) || '://' || regexp_extract({url}, '{PART}', 2) || '/' || array_to_string({once}, '/') else '' end"


def title(html: str) -> str:
    t = f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    t = f"(case when trim({t}) <> '' then {t} else regexp_extract({html}, '(?is)<h1[^>]*>(.*?)</h1>', 1) end)"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def sentences(t: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), '\\s+', ' ', 'g'))"


def bm25(docs: str, terms: str) -> str:
    """CTEs tok, dl, st, tf, df and hits(query_id, doc_id, base, bonus). docs: SQL of (doc_id,
    t); terms: SQL of (query_id, term, mult, nq)."""
    return f"""docs as ({docs}), qt as ({terms}),
st as (select count(*)::double n, greatest(coalesce(avg(len(t)), 1), 1) avgdl from docs),
tf as (select doc_id, term, count(*) tf, any_value(dl) dl from (select doc_id, len(t) dl, unnest(t) term from docs) group by all),
df as (select term, count(*) df from tf group by term),
hits as (select query_id, doc_id, sum(mult * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * greatest(dl, 1) / avgdl)))) base, count(*)::double / any_value(nq) bonus
 from tf join df using (term) join qt using (term) cross join st group by query_id, doc_id having base > 0)"""


def cardinal(n: str) -> str:
    """The Russian cardinal of an integer of 0 to 9999."""
    units = quoted(V.UNITS)
    low = f"case when {n} % 100 < 20 then {units}[{n} % 100 + 1] else {quoted(V.TENS)}[({n} % 100) // 10 - 1] || case when {n} % 10 > 0 then ' ' || {units}[{n} % 10 + 1] else '' end end"
    thousand = quoted([V.THOUSANDS.get(i) or f"{V.UNITS[i]} тысяч" for i in range(1, 10)])
    return f"concat_ws(' ', case when {n} >= 1000 then {thousand}[{n} // 1000] end, case when {n} // 100 % 10 > 0 then {quoted(V.HUNDREDS)}[{n} // 100 % 10] end, case when {n} % 100 > 0 or {n} = 0 then {low} end)"
