"""HTML to plain text with a chain of regular expressions, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements dropped with their content.
DROPPED = ("script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "form", "head")
#: Named entities.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’",
    "middot": "·", "copy": "©", "reg": "®", "times": "×", "laquo": "«", "raquo": "»", "deg": "°", "plusmn": "±", "para": "¶", "sect": "§", "bull": "•",
    "dagger": "†", "trade": "™", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "amp": "&",
}
BLOCKS = r"(?i)<\s*(br|/p|/div|/li|/h[1-6]|/tr|/blockquote|/section|/article)[^>]*>"
LARGEST = 0x10FFFF


def _sign(code: Column) -> Column:
    """The character of a code point; none for surrogates and what lies beyond the last."""
    valid = (code > 0) & (code <= LARGEST) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")


def decode_entities(s: Column) -> Column:
    """Decimal, hexadecimal and named entities. A text is cut before each mark and every piece looked up once; texts without a mark pass."""

    def numeric(p: Column) -> Column:
        ten, sixteen = F.regexp_extract(p, r"^&#(\d{1,9});", 1), F.regexp_extract(p, r"^&#[xX]([0-9A-Fa-f]{1,8});", 1)
        code = F.when(ten != "", ten.cast("long")).when(sixteen != "", F.conv(sixteen, 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.when(p.rlike(r"^&#(\d+|[xX][0-9A-Fa-f]+);"), F.concat(_sign(code), F.regexp_replace(p, r"^&#[0-9A-Fa-fxX]+;", ""))).otherwise(p)

    def named(p: Column) -> Column:
        names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
        sign = F.try_element_at(names, F.lower(F.regexp_extract(p, "^&([A-Za-z]+);", 1)))
        return F.coalesce(F.concat(sign, F.regexp_replace(p, "^&[A-Za-z]+;", "")), p)

    out = F.when(F.contains(s, F.lit("&#")), F.array_join(F.transform(F.split(s, "(?=&#)"), numeric), "")).otherwise(s)
    return F.when(F.contains(out, F.lit("&")), F.array_join(F.transform(F.split(out, "(?=&)"), named), "")).otherwise(out)


def strip_html(h: Column) -> Column:
    """Plain text with one line per block."""
    s = F.regexp_replace(F.coalesce(h, F.lit("")), r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    tags = "|".join(DROPPED)
    for _ in range(2):  # what was inside another element may only now stand whole
        s = F.regexp_replace(s, rf"(?is)<({tags})[^>]*>.*?</\1\s*>", " ")
    s = F.regexp_replace(s, rf"(?i)<(?:{tags})[^>]*>", " ")
    s = F.regexp_replace(s, BLOCKS, "\n")
    s = decode_entities(F.regexp_replace(s, "<[^>]*>", " "))
    s = F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    s = F.regexp_replace(s, r"[ \t\x{A0}]+", " ")
    s = F.regexp_replace(F.regexp_replace(s, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^[\s]+|[\s]+$", "")


def first_image(h: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(h, F.lit("")), r"(?i)<img[^>]+src\s*=\s*[\"']?(https?://[^\"'\s>]+)", 1), F.lit(""))
