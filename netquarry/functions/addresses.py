"""Network addresses of a text line, as one Column expression over built-in functions.

An IPv4 address comes from a maximal run of digits and dots, a MAC or IPv6 address from a maximal run of hex digits,
colons and dashes. All IPv4 addresses of a line come first, then MAC and IPv6 addresses, each in order of position; the
ordinal in that order, from 1, is the field. The text of an address tells its kind, so lines give arrays of strings.

Dialect "ref" keeps the documented quirks of the format (a quad with one more dot is none, a trailing colon belongs to
an IPv6 address, long runs give their first 15 characters); "strict" takes addresses as a reader would.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds and their one-letter codes. Fixed values.
CODES = {"ipv4": "i", "ipv6": "I", "mac": "m"}
#: Addresses of a line at most, and bytes of a line that is parsed at most. Fixed values of the format.
MAX_ADDRESSES = 256
MAX_LINE_BYTES = 8191

H = "[0-9A-Fa-f]"
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
PLAIN_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
QUAD = f"^{OCTET}(?:[.]{OCTET}){{3}}$"
PLAIN_QUAD = f"^{PLAIN_OCTET}(?:[.]{PLAIN_OCTET}){{3}}$"
#: Maximal runs that hold a dot, and those that hold a colon or dash.
DOT_RUNS = "[0-9]*[.][0-9.]*"
COLON_RUNS = f"{H}*[:-][0-9A-Fa-f:-]*"

MAC = f"^(?:{H}{{2}}(?::{H}{{2}}){{5}}|{H}{{2}}(?:-{H}{{2}}){{5}})"
IPV6_FULL = f"^(?:{H}{{1,4}}:){{7}}{H}{{1,4}}:?$"
IPV6_SHORT = f"^(?:{H}{{1,4}}(?::{H}{{1,4}})*:::?|::)(?:{H}{{1,4}}(?::{H}{{1,4}})*:?)?$"
#: A run whose last group is a quad, with the character after it, which no run can hold; other runs as they are.
DIGITS = "[0-9]{1,3}"
TAIL = f":{DIGITS}[.]{DIGITS}[.]{DIGITS}[.]{DIGITS}"
MIXED_RUNS = f"[0-9A-Fa-f:]*{TAIL}(?:[^0-9A-Fa-f:.-]|$)|{COLON_RUNS}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def octets(quad: Column) -> Column:
    """The four numbers of a quad; null where one isn't a number."""
    return F.transform(F.split(quad, "[.]"), lambda x: x.try_cast("int"))


def is_quad(text: Column) -> Column:
    return F.rlike(text, F.lit(QUAD))


def normal_quad(quad: Column) -> Column:
    """A quad without leading zeros."""
    return F.regexp_replace(quad, "(^|[.])0+([0-9])", "$1$2")


def ipv4_of(text: Column, dialect: str) -> Column:
    """IPv4 addresses of a line."""
    runs = F.regexp_extract_all(text, F.lit(DOT_RUNS), F.lit(0))
    known = lambda of: F.filter(of, lambda x: x.isNotNull())
    # Most quads have no leading zero and are done with one test.
    quad = lambda r: F.when(F.rlike(r, F.lit(PLAIN_QUAD)), r).when(is_quad(r), normal_quad(r))
    if dialect == "strict":
        return known(F.transform(runs, lambda r: quad(F.btrim(r, F.lit(".")))))

    def odd(r: Column) -> Column:
        # A longer run is read up to its 15th character, once more for each dot after that.
        rest = F.substring(r, 16, 1 << 30)
        times = 1 + F.char_length(rest) - F.char_length(F.replace(rest, F.lit("."), F.lit("")))
        return F.array_repeat(normal_quad(F.left(r, F.lit(15))), times)

    each = lambda rs: F.flatten(F.transform(F.filter(rs, lambda r: is_quad(F.left(r, F.lit(15)))), odd))
    long = lambda rs: F.exists(rs, lambda r: F.char_length(r) > 15)
    return _let(runs, lambda rs: F.when(long(rs), each(rs)).otherwise(known(F.transform(rs, quad))))


def _without(text: Column, char: str) -> Column:
    return F.char_length(F.replace(text, F.lit(char), F.lit("")))


def is_ipv6(s: Column, fewest: int) -> Column:
    """Whether s is an IPv6 address of at most eight groups, the third of three colons counted as one."""
    groups = F.size(F.regexp_extract_all(s, F.lit(f"{H}+"), F.lit(0)))
    colons = F.char_length(s) - _without(s, ":")
    # The groups are never more than the colons, so they are seldom counted.
    few = (colons <= 8) | (groups + F.contains(s, F.lit(":::")).cast("int") <= 8)
    shape = F.contains(s, F.lit("::")) & F.rlike(s, F.lit(IPV6_SHORT)) | (colons >= 7) & F.rlike(s, F.lit(IPV6_FULL))
    return shape & (few & (groups >= fewest) if fewest else few)


def is_mac(r: Column) -> Column:
    """Whether a MAC or IPv6 address, as keys have them, is a MAC. No IPv6 address has the like."""
    return (F.char_length(r) == 17) & ~F.contains(r, F.lit("::")) & (_without(r, ":") == 12)


def kind_of(address: Column) -> Column:
    """The kind of an address by its text."""
    other = F.when(is_mac(address), F.lit("mac")).otherwise(F.lit("ipv6"))
    return F.when(F.contains(address, F.lit(":")), other).otherwise(F.lit("ipv4"))


def code_of(address: Column) -> Column:
    """The one-letter code of an address's kind."""
    other = F.when(is_mac(address), CODES["mac"]).otherwise(CODES["ipv6"])
    return F.when(F.contains(address, F.lit(":")), other).otherwise(F.lit(CODES["ipv4"]))


def hardware_of(text: Column, dialect: str) -> Column:
    """MAC and IPv6 addresses of a line."""
    fewest = 2 if dialect == "strict" else 0
    # In strict, one colon at the end is punctuation.
    trimmed = lambda s: F.when(F.rlike(s, F.lit("[^:]:$")), F.left(s, F.char_length(s) - 1)).otherwise(s)
    head = (lambda s, then: _let(trimmed(s), then)) if dialect == "strict" else (lambda s, then: then(s))
    mac = lambda r: F.lower(F.replace(r, F.lit("-"), F.lit(":")))
    ipv6 = lambda r: head(r, lambda s: F.when(is_ipv6(s, fewest), s))

    def run(r: Column) -> Column:
        first = F.left(F.substring_index(r, "-", 1), F.lit(39))
        is_one = (F.char_length(r) >= 17) & F.rlike(r, F.lit(MAC))
        return F.when(is_one, mac(F.left(r, F.lit(17)))).when(F.contains(r, F.lit(":")), _let(first, ipv6))

    def mixed(r: Column) -> Column:
        """A run that may end in a quad, which stands for its last two groups."""
        whole = F.when(F.rlike(r, F.lit("[0-9]$")), r).otherwise(F.left(r, F.char_length(r) - 1))

        def judge(s: Column) -> Column:
            groups = F.regexp_replace(s, "[0-9.]+$", "")
            good = is_quad(F.substring_index(s, ":", -1)) & is_ipv6(F.concat(groups, F.lit("0:0")), fewest)
            if dialect == "ref":
                good = good & (F.size(F.regexp_extract_all(groups, F.lit(f"{H}+"), F.lit(0))) >= 6)
            return F.when(good, s).otherwise(_let(F.substring_index(s, ".", 1), run))

        return F.when(F.contains(r, F.lit(".")), _let(whole, judge)).otherwise(run(r))

    known = lambda found: F.filter(found, lambda x: x.isNotNull())
    # A MAC has 17 characters; an IPv6 address has two colons side by side, or 15 characters at least.
    likely = lambda r: F.contains(r, F.lit("::")) | (F.char_length(r) >= 15)
    plain = F.transform(F.filter(F.regexp_extract_all(text, F.lit(COLON_RUNS), F.lit(0)), likely), run)
    other = F.transform(F.regexp_extract_all(text, F.lit(MIXED_RUNS), F.lit(0)), mixed)
    return F.when(F.rlike(text, F.lit(TAIL)), known(other)).otherwise(known(plain))


def found(
    text: Column | str,
    dialect: str = "ref",
    kinds: Sequence[str] | None = None,
    max_line_bytes: int | None = -1,
    max_addresses: int | None = -1,
) -> Column:
    """The addresses of a line, array<string>; the field of an address is its place in it, from 1.

    kinds: where only ipv4 is wanted the others aren't looked for; otherwise all are found, since fields count them.
    max_line_bytes: longer lines give nothing (ref: 8191, strict: no limit). max_addresses: those beyond it are left out
    (ref: 256, strict: no limit). Null gives an empty array.
    """
    if dialect not in ("ref", "strict"):
        raise ValueError(f"unknown dialect {dialect!r}")
    if bad := set(kinds or ()) - set(CODES):
        raise ValueError(f"unknown kinds {sorted(bad)}")
    text = F.col(text) if isinstance(text, str) else text
    limit = (MAX_LINE_BYTES if dialect == "ref" else None) if max_line_bytes == -1 else max_line_bytes
    most = (MAX_ADDRESSES if dialect == "ref" else None) if max_addresses == -1 else max_addresses
    none = F.array().cast("array<string>")
    every = F.when(F.contains(text, F.lit(".")), ipv4_of(text, dialect)).otherwise(none)
    if set(kinds or CODES) != {"ipv4"}:
        colons = F.contains(text, F.lit(":")) | F.contains(text, F.lit("-"))
        every = F.concat(every, F.when(colons, hardware_of(text, dialect)).otherwise(none))
    size = F.octet_length(text)
    out = every if most is None else F.slice(every, 1, most)
    out = F.when(text.isNull() | (size > limit) if limit is not None else text.isNull(), none).otherwise(out)
    # Each address takes a byte at least, the repeats of a long run too, so a short line has not too many.
    return out if most is None else F.when(size <= min(most, most if limit is None else limit), every).otherwise(out)


def with_fields(addresses_: Column, kinds: Sequence[str] | None = None) -> Column:
    """array<struct<kind, address, field>> of what found() gives, of the given kinds only."""
    out = F.transform(addresses_, lambda x, i: F.struct(kind_of(x).alias("kind"), x.alias("address"), (i + 1).alias("field")))
    return F.filter(out, lambda x: x["kind"].isin(*kinds)) if kinds else out


def addresses(
    text: Column | str,
    dialect: str = "ref",
    kinds: Sequence[str] | None = None,
    max_line_bytes: int | None = -1,
    max_addresses: int | None = -1,
) -> Column:
    """array<struct<kind, address, field>> of a line. kinds: only those, with the fields that they have among all."""
    return with_fields(found(text, dialect, kinds, max_line_bytes, max_addresses), kinds)


def field(addresses_: Column, n: int) -> Column:
    """The n-th address of a line, from 1, or null. addresses_: what found() gives."""
    return F.get(addresses_, F.lit(n - 1))


def template(addresses_: Column) -> Column:
    """A line's template: the codes of its addresses, each after a percent sign. addresses_: what found() gives."""
    return F.array_join(F.transform(addresses_, lambda x: F.concat(F.lit("%"), code_of(x))), "")
