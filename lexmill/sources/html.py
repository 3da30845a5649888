"""Plain text of HTML by built-in expressions: elements that show nothing go, tags become blanks."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every name of HTML's references, with its semicolon where it has one, and what it stands for.
NAMES = html5
#: The names that may go without a semicolon.
_BARE = {n: s for n, s in NAMES.items() if not n.endswith(";")}


def _numeric(part: Column) -> Column:
    """What stands behind an ampersand and begins with #: decoded if it names a character, else as it was."""
    dec, hexa = F.regexp_extract(part, r"^#([0-9]{1,7});", 1), F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
    n = F.when(dec != "", dec.try_cast("int")).when(hexa != "", F.conv(hexa, 16, 10).try_cast("int"))
    valid = F.coalesce(n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.lit(False))
    sign = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n).otherwise(32)), 8, "0")), "UTF-32")
    return F.when(valid, F.concat(sign, F.regexp_replace(part, "^[^;]*;", "")))


def _named(part: Column, bare_too: bool) -> Column:
    """The longest name that stands behind an ampersand, decoded, and the rest; null if there is none. bare_too: also those that
    may go without a semicolon, without one."""
    table = lambda names: F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    short, full, bare = (table({n: NAMES[n] for n in names}) for names in ([f"{n}" for n in NAMES if n.rstrip(";") in _BARE], NAMES, _BARE))
    name = F.regexp_extract(part, "^[a-zA-Z][a-zA-Z0-9]{0,31};" + "?" * bare_too, 0)
    rest = lambda n: F.substring(part, n + 1, F.length(part))
    cuts = [F.concat(F.try_element_at(bare, F.substring(name, 1, n)), rest(F.lit(n))) for n in range(max(map(len, _BARE)), 1, -1)] if bare_too else []
    return F.when(name != "", F.coalesce(*[F.concat(F.try_element_at(t, name), rest(F.length(name))) for t in (short, full)], *cuts))


def references(c: Column, bare_too: bool = True) -> Column:
    """Character references decoded, each once: numeric ones with a semicolon that name a character, and all of HTML's names, with a
    semicolon or (bare_too), for those that may, without, the longest that fits. Other ampersands stay."""
    parts = F.split(c, "&")
    one = lambda p: F.coalesce(F.when(F.startswith(p, F.lit("#")), _numeric(p)).otherwise(_named(p, bare_too)), F.concat(F.lit("&"), p))
    decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)


def html_text(c: Column, bare_too: bool = True) -> Column:
    """The text of a page: script, style, noscript, iframe and comments go, tags become blanks, references, named
    and numeric, are decoded (see references), white space is collapsed."""
    out = c
    for tag in ("script", "style", "noscript", "iframe"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    out = references(out, bare_too)
    return F.trim(F.regexp_replace(out, r"\s+", " "))
