"""The same extraction as SQL for a second engine, for the registered queries' expected results.

Patterns and limits are written anew here, so that a mistake in those of the Column form shows.
"""

from __future__ import annotations

#: Fixed values of the format.
LIMIT, MOST = 8191, 256
X = "[[:xdigit:]]"
RUNS = "[[:xdigit:]:-]+"
QUAD_END = ":[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"


def quad_ok(x: str) -> str:
    octet_bad = f"len(list_filter(string_split({x}, '.'), lambda o: try_cast(o AS INTEGER) > 255)) > 0"
    return f"(regexp_matches({x}, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') AND NOT {octet_bad})"


def quad(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, '.'), lambda o: CAST(try_cast(o AS INTEGER) AS VARCHAR)), '.')"


def groups(s: str) -> str:
    return f"len(regexp_extract_all({s}, '{X}+'))"


def ipv6_ok(s: str, fewest: int = 0) -> str:
    full = f"regexp_matches({s}, '^({X}{{1,4}}:){{7}}{X}{{1,4}}:?$')"
    short = f"regexp_matches({s}, '^({X}{{1,4}}(:{X}{{1,4}})*:::?|::)({X}{{1,4}}(:{X}{{1,4}})*:?)?$')"
    few = f"{groups(s)} + CASE WHEN contains({s}, ':::') THEN 1 ELSE 0 END <= 8"
    return f"(({full} OR ({short} AND {few})) AND {groups(s)} >= {fewest})"


def found(text: str, limit: int | None = LIMIT, dialect: str = "ref", most: int | None = MOST) -> str:
    """A list of kind, address and code structs of a text."""
    ref = dialect == "ref"
    fewest = 0 if ref else 2
    runs = f"list_filter(regexp_extract_all({text}, '[0-9.]+'), lambda r: contains(r, '.'))"
    part = "substr(r, 1, 15)" if ref else "trim(r, '.')"
    times = "CASE WHEN length(r) <= 15 THEN 1 ELSE 1 + length(substr(r, 16)) - length(replace(substr(r, 16), '.', '')) END" if ref else "1"
    made = f"list_transform(range({times}), lambda i: {{'kind': 'ipv4', 'code': 'i', 'address': {quad(part)}}})"
    v4 = f"flatten(list_transform(list_filter({runs}, lambda r: {quad_ok(part)}), lambda r: {made}))"
    mac_ok = f"regexp_matches(r, '^({X}{{2}}(:{X}{{2}}){{5}}|{X}{{2}}(-{X}{{2}}){{5}})')"
    first = "substr(split_part(split_part(r, '.', 1), '-', 1), 1, 39)"
    s = first if ref else f"regexp_replace({first}, '([^:]):$', '\\1')"
    # A run that ends in a quad is taken with the character after it, which no run can hold.
    whole = "regexp_replace(r, '[^0-9]$', '')"
    before = f"regexp_replace({whole}, '[0-9.]+$', '')"
    last = f"regexp_extract({whole}, '[0-9.]+$')"
    enough = f" AND {groups(before)} >= 6" if ref else ""
    mixed_ok = f"(contains(r, '.') AND {quad_ok(last)} AND {ipv6_ok(f'concat({before}, {chr(39)}0:0{chr(39)})', fewest)}{enough})"
    every = f"regexp_extract_all({text}, '[[:xdigit:]:]*{QUAD_END}([^[:xdigit:]:.-]|$)|{RUNS}')"
    cruns = f"list_filter({every}, lambda r: (contains(r, ':') OR contains(r, '-')) AND ({mixed_ok} OR {mac_ok} OR {ipv6_ok(s, fewest)}))"
    mac = "{'kind': 'mac', 'code': 'm', 'address': lower(replace(substr(r, 1, 17), '-', ':'))}"
    rest = f"""list_transform({cruns}, lambda r: CASE WHEN {mixed_ok} THEN {{'kind': 'ipv6', 'code': 'I', 'address': {whole}}}
        WHEN {mac_ok} THEN {mac} ELSE {{'kind': 'ipv6', 'code': 'I', 'address': {s}}} END)"""
    both = f"list_concat({v4}, {rest})" + (f"[1:{most}]" if most else "")
    return both if limit is None else f"CASE WHEN strlen({text}) <= {limit} THEN {both} ELSE [] END"


def lines(table: str, text: str, file: str) -> str:
    """file, line_no and text of the lines of a table's text column."""
    parts = f"string_split({text}, chr(10))"
    return f"""(SELECT file, line_no, text FROM (SELECT CAST({file} AS VARCHAR) AS file, unnest({parts}) AS text,
        unnest(range(1, len({parts}) + 1)) AS line_no, len({parts}) AS n FROM {table}) WHERE text <> '' OR line_no < n)"""


SYNTHETIC = """(SELECT 'synthetic.log' AS file, event_id + 1 AS line_no, concat('src=10.', user_id % 4, '.', event_id % 16, '.', event_id % 32,
        ' dst=192.168.1.', user_id % 10, ' mac=02:00:00:00:00:', lpad(lower(hex(event_id % 256)), 2, '0'), ' v6=2001:db8::', lower(hex(user_id))) AS text
        FROM events)"""


def occurrences(source: str, kinds: str = "", limit: int | None = LIMIT, dialect: str = "ref", most: int | None = MOST) -> str:
    """file, line_no, field, kind and address."""
    where = f" WHERE x.kind IN ({kinds})" if kinds else ""
    return f"""(SELECT file, line_no, field, x.kind AS kind, x.code AS code, x.address AS address FROM
        (SELECT file, line_no, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS field
        FROM (SELECT file, line_no, {found('text', limit, dialect, most)} AS a FROM {source} AS s) AS f) AS g{where})"""


def index(occ: str, keys: str = "") -> str:
    """[keys,] address, kind, n and record."""
    more = f"{keys}, " if keys else ""
    return f"""SELECT {more}address, kind, n, concat_ws(',', address, CAST(n AS VARCHAR), places) AS record FROM (SELECT {more}address, kind, count(*) AS n,
        string_agg(line_no || ':' || field, ',' ORDER BY line_no, field) AS places FROM {occ} AS o GROUP BY {more}address, kind) AS i"""
