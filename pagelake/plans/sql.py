"""Pieces of DuckDB SQL that restate the column functions, for the queries' SQL."""

from __future__ import annotations

from pagelake.functions import languages, urls

BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def blank_to_null(c: str) -> str:
    return f"nullif({strip(c)}, '')"


def digest_key(c: str) -> str:
    return f"lower({blank_to_null(c)})"


def strings(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def parsed(source: str, column: str) -> str:
    """``source`` with the parts of the address in ``column``: scheme, host, port, path, query, reason, norm, norm_slash, origin_port."""
    track = f"starts_with(lower(x.k), 'utm_') OR lower(x.k) IN ({strings(urls.TRACKING_KEYS)})"
    decode = lambda e: rf"url_decode(replace(regexp_replace({e}, '%([^0-9A-Fa-f]|$|[0-9A-Fa-f]([^0-9A-Fa-f]|$))', '%25\1', 'g'), '+', ' '))"
    encode = lambda e: f"replace(url_encode({e}), '%20', '+')"
    pairs = (
        f"list_transform(list_filter(string_split(query, '&'), lambda y: y <> ''), lambda y: {{'k': {decode(chr(39).join(['regexp_replace(y, ', '(?s)=.*$', ', ', '', ')']))}, "
        f"'v': CASE WHEN contains(y, '=') THEN {decode(chr(39).join(['regexp_replace(y, ', '(?s)^[^=]*=', ', ', '', ')']))} ELSE '' END}})"
    )
    return rf"""(SELECT *, CASE WHEN reason IS NULL THEN base || tail END AS norm,
  CASE WHEN reason IS NULL THEN base || tail || CASE WHEN ends_with(path, '/') AND path2 <> '/' THEN '/' ELSE '' END END AS norm_slash,
  CASE WHEN reason IS NULL THEN coalesce(nullif(try_cast(port AS INT), 0), CASE scheme WHEN 'https' THEN 443 ELSE 80 END) END AS origin_port
 FROM (SELECT *, scheme || '://' || host || CASE WHEN port IS NULL OR port_no = CASE scheme WHEN 'https' THEN 443 ELSE 80 END THEN '' ELSE ':' || port_no END || path2 AS base,
  CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(list_sort(kept), lambda x: {encode('x.k')} || '=' || {encode('x.v')}), '&') END AS tail
 FROM (SELECT *, CASE WHEN path1 = '/' THEN path1 ELSE regexp_replace(path1, '/$', '') END AS path2, try_cast(port AS INT) AS port_no,
  CASE WHEN u IS NULL THEN 'missing' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN contains(auth, '@') THEN 'userinfo'
   WHEN regexp_matches(host, '[\[\]:\s]') OR host = '' THEN 'host' WHEN port IS NOT NULL AND (NOT regexp_full_match(port, '[0-9]{{1,5}}') OR try_cast(port AS INT) > 65535) THEN 'port' END AS reason,
  list_filter(pairs, lambda x: NOT ({track})) AS kept
 FROM (SELECT *, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/{{2,}}', '/', 'g') AS path1, {pairs} AS pairs
 FROM (SELECT *, lower(p.s) AS scheme, p.a AS auth, rtrim(lower(regexp_replace(regexp_replace(p.a, '(?s)^.*@', ''), ':[^:]*$', '')), '.') AS host,
  nullif(regexp_extract(regexp_replace(p.a, '(?s)^.*@', ''), ':([^:]*)$', 1), '') AS port, p.p AS path, substr(p.q, 2) AS query
 FROM (SELECT *, regexp_extract(u, '(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', ['s', 'a', 'p', 'q', 'f']) AS p
 FROM (SELECT *, regexp_replace({strip(column)}, '[\t\r\n]', '', 'g') AS u FROM {source}))))))) """


def instant(c: str) -> str:
    t = f"replace(replace(upper({strip(c)}), 'T', ' '), ',', '.')"
    return f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(CASE WHEN regexp_matches({t}, '(Z|[+\\-][0-9:]+)$') THEN {t} ELSE {t} || 'Z' END AS TIMESTAMPTZ) END"


def code(c: str) -> str:
    return f"nullif(replace(lower({strip(f'''split_part(split_part({c}, ',', 1), ';', 1)''')}), '_', '-'), '')"


def languages_in_url() -> str:
    """Over ``parsed``: places, the code found and where."""
    known = strings(languages.ENGLISH + languages.NON_ENGLISH)
    return f"""CASE WHEN replace(split_part(host, '.', 1), '_', '-') IN ({known}) THEN replace(split_part(host, '.', 1), '_', '-')
      ELSE list_filter(list_transform(list_filter(string_split(lower(path), '/'), lambda y: {strip('y')} <> '')[1:2], lambda y: replace(y, '_', '-')), lambda y: y IN ({known}))[1] END"""


def md_normal(c: str) -> str:
    s = rf"regexp_replace(regexp_replace(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '\[{BLANK}*\]\([^)]*\)', '', 'g')"
    s = rf"regexp_replace(regexp_replace({s}, '!\[{BLANK}*\]\({BLANK}*\)', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"CASE WHEN {strip(s)} = '' THEN '' ELSE {strip(s)} || chr(10) END"


def slug(c: str) -> str:
    s = rf"trim(regexp_replace(regexp_replace({strip(f'lower({c})')}, '[^a-z0-9._\-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '-._')"
    return f"coalesce(nullif({s}, ''), 'page')"


def plain(c: str) -> str:
    """The letters without their marks, what isn't ASCII then left out."""
    return rf"regexp_replace(strip_accents({c}), '[^\x00-\x7f]', '', 'g')"
