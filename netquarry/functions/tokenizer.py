"""Templates of whole lines: every token by its kind, punctuation and blanks as they stand.

A token is a quoted text, a MAC, IPv6 or IPv4 address, or a maximal run of letters, digits, underscores and characters
beyond ASCII. What an address is followed by without a gap belongs to it and makes it a string.

These are columns, for any query; token_batches counts the same tokens of many lines with far less work for each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import OCTET, H

#: Codes of tokens: MAC, IPv6 and IPv4 address, hex number, whole number, single character, string. Fixed values.
CODES = {"mac": "m", "ipv6": "I", "ipv4": "i", "hex": "x", "int": "d", "char": "c", "string": "s"}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]"
GROUPS = f"{H}{{1,4}}(?::{H}{{1,4}})*"
SHAPES = {
    "mac": f"{H}{{2}}(?::{H}{{2}}){{5}}|{H}{{2}}(?:-{H}{{2}}){{5}}",
    "ipv6": f"(?:{H}{{1,4}}:){{7}}{H}{{1,4}}|(?:{GROUPS})?::{GROUPS}",
    "ipv4": f"{OCTET}(?:[.]{OCTET}){{3}}",
    "hex": f"0[xX]{H}+",
    "int": "[0-9]+",
    "char": WORD,
    "string": f"(?s:{WORD}.*)",
}
TOKEN = "|".join(['"[^"]*"', *(f"(?:{SHAPES[k]}){WORD}*" for k in ("mac", "ipv6", "ipv4")), f"{WORD}+", "(?s:.)"])
#: Colons that an IPv6 address has at most.
COLONS = 7


def kind_of_token(token: Column) -> Column:
    """The kind of a token that isn't quoted; null for punctuation and blanks."""
    few = F.char_length(token) - F.char_length(F.replace(token, F.lit(":"), F.lit(""))) <= COLONS
    out: Column | None = None
    for kind, shape in SHAPES.items():
        # Not a dollar sign, which also matches before a line separator at the end.
        fits = F.rlike(token, F.lit(rf"^(?:{shape})\z"))
        out = (F if out is None else out).when(fits & few if kind == "ipv6" else fits, F.lit(kind))
    # An address with something behind it.
    return out.when((F.char_length(token) > 1) & ~F.startswith(token, F.lit('"')), F.lit("string"))


def tokens(text: Column | str) -> Column:
    """array<struct<kind, text>> of a line's tokens; a quoted text is a string without its quotes. Null gives none."""
    quoted = lambda t: F.startswith(t, F.lit('"')) & (F.char_length(t) > 1)
    every = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    plain = lambda t: F.when(quoted(t), F.substring(t, 2, F.char_length(t) - 2)).otherwise(t)
    named = F.transform(every, lambda t: F.struct(F.when(quoted(t), F.lit("string")).otherwise(kind_of_token(t)).alias("kind"), plain(t).alias("text")))
    return F.coalesce(F.filter(named, lambda x: x["kind"].isNotNull()), F.array().cast("array<struct<kind:string,text:string>>"))


def line_template(text: Column | str) -> Column:
    """The line with a percent sign and a code for each token. A percent sign of the line is doubled; null gives "".

    It never is null, so that a join on it doesn't put a filter that repeats the tokenizing below itself.
    """
    code = F.create_map(*(F.lit(x) for kind in CODES.items() for x in kind))

    def one(t: Column) -> Column:
        is_quoted = F.startswith(t, F.lit('"')) & (F.char_length(t) > 1)
        known = F.concat(F.lit("%"), F.element_at(code, kind_of_token(t)))
        return F.when(is_quoted, F.lit('"%s"')).when(t == "%", F.lit("%%")).otherwise(F.coalesce(known, t))

    every = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.coalesce(F.array_join(F.transform(every, one), ""), F.lit(""))
