"""Names, tickers, sectors and entities as Catalyst expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.schema import GICS_SECTORS, SECTOR_ALIASES

NBSP = " "
#: Words of a company's legal form, and class marks, that do not tell companies apart.
LEGAL_WORDS = ("inc", "corp", "corporation", "company", "co", "ltd", "plc", "holdings", "holding", "group", "the", "sa", "nv")
SHARE_CLASS = r"\b(class|series)\s+[a-c]\b"
#: Named entities in the order in which they are replaced; & comes first, so text may decode twice.
ENTITIES = (
    (r"&amp;", "&"),
    (r"&#0?39;|&apos;|&rsquo;", "'"),
    (r"&quot;", '"'),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&nbsp;", " "),
)


def trimmed(c: Column) -> Column:
    """Without white space at both ends, no-break spaces too."""
    return F.regexp_replace(c, rf"^[\s{NBSP}]+|[\s{NBSP}]+$", "")


def ticker(c: Column) -> Column:
    return F.replace(F.upper(trimmed(c)), F.lit("."), F.lit("-"))


def company_key(c: Column) -> Column:
    """What stays of a name without punctuation, share class and legal form."""
    bare = F.translate(F.lower(c), ".,'()", "")
    bare = F.regexp_replace(bare, SHARE_CLASS, "")
    bare = F.regexp_replace(bare, rf"\b({'|'.join(LEGAL_WORDS)})\b", "")
    return trimmed(F.regexp_replace(bare, rf"[\s{NBSP}]+", " "))


def decoded(c: Column) -> Column:
    """Entities as characters; numeric ones by their code point. What is no code point stays as it is."""
    for pattern, plain in ENTITIES:
        c = F.regexp_replace(c, pattern, plain)
    # Text between numeric entities stays; each entity's number becomes its character.
    parts = F.regexp_extract_all(c, F.lit(r"(?s)&#\d+;|(?:(?!&#\d+;).)+"), 0)
    number = lambda p: F.regexp_extract(p, r"^&#(\d+);$", 1).try_cast("bigint")
    valid = lambda n: (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    one = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    # Surrogates stand for no character of their own, so they stay text like numbers that are too large.
    return F.array_join(F.transform(parts, lambda p: F.when(valid(number(p)), one(F.when(valid(number(p)), number(p)))).otherwise(p)), "")


def sector(c: Column) -> Column:
    """The canonical sector, or Unknown."""
    known = {s.lower(): s for s in GICS_SECTORS} | SECTOR_ALIASES
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    return F.coalesce(F.try_element_at(table, F.lower(trimmed(c))), F.lit("Unknown"))


def number_or_null(c: Column) -> Column:
    """A finite double, or null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def text_or_null(c: Column) -> Column:
    return F.when(c != "", c)
