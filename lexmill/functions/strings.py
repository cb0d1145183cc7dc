"""String helpers as column expressions. Regular expressions are written so that Java's and RE2's
engines read them alike; character classes are explicit where the engines' own differ."""

from __future__ import annotations

import functools
import html as html_lib
import html.entities
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the four separators U+001C to U+001F.
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# The code-point ranges that count as one token a character.
TOKEN_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3000}-\x{303F}]"
# Ideographs of Hanja annotations, and those that a reading has a syllable for.
IDEOGRAPH = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
SYLLABLE_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}]"


def vectorised(kind: str):
    """Makes a function over pandas Series one over columns; the UDF is built where it is used."""

    def wrap(f):
        @functools.wraps(f)
        def column(*cols: Column) -> Column:
            return F.pandas_udf(f, kind)(*cols)

        return column

    return wrap


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, where the expression would else repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def squeeze(text: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def is_blank(text: Column) -> Column:
    return strip(blank_if_null(text)) == ""


@vectorised("string")
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@vectorised("string")
def unescape(text: pd.Series) -> pd.Series:
    """All HTML5 entities."""
    return text.map(lambda t: None if t is None else html_lib.unescape(t))


@vectorised("string")
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


#: Entities that the native unescape knows, ampersand last.
COMMON_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def unescape_common(text: Column, entities: dict[str, str] = COMMON_ENTITIES) -> Column:
    """The entities of a table, one after the other; enough for text this engine escaped itself."""
    for entity, char in entities.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


ENTITY = r"&(#[0-9]{1,8}|#[xX][0-9A-Fa-f]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"


@functools.cache
def _entity_table() -> str:
    """Names of HTML5 entities, and the numbers that HTML reads otherwise, as a JSON object."""
    named = {k[:-1]: v for k, v in html_lib.entities.html5.items() if k.endswith(";")}
    odd = {f"#{n}": html_lib.unescape(f"&#{n};") for n in (0, *range(0x80, 0xA0))}
    return json.dumps(named | odd)


def unescape_each(text: Column) -> Column:
    """All entities that end with a semicolon, in one pass and without Python, also inside lambdas."""
    table = F.from_json(F.lit(_entity_table()), "map<string,string>")

    def plain(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^" + ENTITY, 1)
        digits = F.when(F.startswith(name, F.lit("#")), F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 7), 16, 10)).otherwise(F.substring(name, 2, 8)))
        code = digits.cast("bigint")
        number = F.when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        value = F.when(name != "", F.coalesce(F.try_element_at(table, name), number))
        return F.when(value.isNull(), piece).otherwise(F.concat(value, F.substr(piece, F.length(name) + 3)))

    parts = F.transform(F.split(text, f"(?={ENTITY})"), plain)
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def escape(text: Column) -> Column:
    """HTML escape of &, < and >; quotes stay."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


TAG = r"<[^>]+>"


def strip_html(text: Column, entities: dict[str, str] | None = None) -> Column:
    """Text without tags: tags go first, entities after (as HTML reads them, or those of a table only), NBSP becomes a space."""
    bare = F.regexp_replace(text, TAG, "")
    bare = unescape(bare) if entities is None else unescape_common(bare, entities)
    return strip(F.replace(bare, F.lit(" "), F.lit(" ")))


def term_key(term: Column) -> Column:
    return nfc(strip(term))


def estimate_tokens(text: Column) -> Column:
    """One per CJK or Hangul character and one per four others, rounded up."""
    text = blank_if_null(text)
    rest = F.length(F.regexp_replace(text, TOKEN_CJK, ""))
    return (F.length(text) - rest + F.floor((rest + 3) / 4)).cast("bigint")


def hanja_of(text: Column) -> Column:
    """The ideographs of a text, in order."""
    return F.regexp_replace(blank_if_null(text), IDEOGRAPH.replace("[", "[^", 1), "")


def resolve_hanja(inline: Column, text: Column) -> Column:
    """An annotation, else ideographs within the text, else blank."""
    return F.coalesce(F.nullif(blank_if_null(inline), F.lit("")), hanja_of(text))


def encode_indices(positions: Column) -> Column:
    """0-based positions as a sorted, distinct, 1-based list."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(positions)), lambda i: (i + 1).cast("string")), ",")


def parse_indices(detail: Column) -> Column:
    """0-based positions of all numbers from 1 on in a text."""
    numbers = F.transform(F.regexp_extract_all(blank_if_null(detail), F.lit(r"\p{Nd}+"), F.lit(0)), lambda x: F.try_to_number(F.right(F.concat(F.lit("0" * 18), x), F.lit(18)), F.lit("9" * 18)).cast("bigint"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(numbers, lambda n: n >= 1), lambda n: (n - 1).cast("int"))))


def tsv_safe(text: Column) -> Column:
    """Tabs and line breaks as character references; a CR LF pair becomes one."""
    text = F.replace(blank_if_null(text), F.lit("\t"), F.lit("&#9;"))
    return F.regexp_replace(text, r"\r\n|\n|\r", "&#10;")


def slug(text: Column, fallback: str) -> Column:
    made = F.lower(F.regexp_replace(F.regexp_replace(blank_if_null(text), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+\z", ""))
    return F.when(made == "", F.lit(fallback)).otherwise(made)


def short_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def snippet(text: Column, most: int) -> Column:
    """White space folded, cut to ``most`` characters with an ellipsis."""
    folded = squeeze(blank_if_null(text))
    return F.when(F.length(folded) > most, F.concat(F.left(folded, F.lit(most)), F.lit("…"))).otherwise(folded)


def json_payload(text: Column) -> Column:
    """The outermost object of a reply that may be fenced or chatty; blank if there is none."""
    bare = F.regexp_replace(blank_if_null(text), r"```[A-Za-z]*", "")
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1))
    known = F.create_map(*[F.lit(x) for pair in {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix), F.lit("image/png"))
