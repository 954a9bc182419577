"""Column functions over texts; all but the Unicode fold are Spark's own."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of Unicode, spelled out: Java's \s is narrower.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same for text that has been folded to ASCII, with a character class that matches faster.
ASCII_SPACE = r"\x09-\x0D\x1C-\x20"
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Applied one after the other: "&amp;lt;" becomes "<".
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'))


@F.arrow_udf(T.StringType())
def ascii_fold(text: pa.Array) -> pa.Array:
    """Compatibility decomposition, then only ASCII stays. Arrow kernels over whole batches."""
    return pc.replace_substring_regex(pc.utf8_normalize(text, form="NFKD"), pattern=r"[^\x00-\x7F]", replacement="")


def squeezed(text: Column, space: str = SPACE) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{space}]+", " "))


def without_noise(text: Column, space: str = SPACE) -> Column:
    """No reference marks, no addresses, entities decoded, white space collapsed."""
    for pattern in (r"\[\d+\]", r"(?i)\[citation needed\]", r"(?i)\[edit\]", f"https?://[^{space}]+"):
        text = F.regexp_replace(text, pattern, "")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return squeezed(text, space)


def sentences(text: Column, space: str = SPACE) -> Column:
    """Cut at white space between a sentence's end and a capital; empty parts go."""
    parts = F.split(text, f"(?<=[.!?])[{space}]+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda x: F.trim(x, F.lit(_WHITE))), lambda x: x != "")


def keyed(parts: Column) -> Column:
    """Sentences with key and place, sorted: what ``firsts`` wants, as a column of its own."""
    return F.array_sort(F.transform(parts, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("s"))))


def firsts(ordered: Column) -> Column:
    """The first of those alike but for case, in the order of the text: sorted neighbours are compared.

    ``ordered`` is read three times, so it should be a column, not an expression.
    """
    size = F.greatest(F.size(ordered) - 1, F.lit(0))
    before = F.concat(F.array(F.lit(None).cast("struct<k:string,i:int,s:string>")), F.slice(ordered, 1, size))
    kept = F.zip_with(ordered, before, lambda a, b: F.when(a.isNotNull() & (b.isNull() | (a["k"] != b["k"])), F.struct(a["i"].alias("i"), a["s"].alias("s"))))
    return F.transform(F.array_sort(F.array_compact(kept)), lambda x: x["s"])


def words(text: Column) -> Column:
    """Lower-cased words."""
    plain = squeezed(F.lower(text))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def without_possessive(text: Column, as_coded: bool = False) -> Column:
    """``Thiel's`` becomes ``Thiel``. ``as_coded``: every trailing s and apostrophe goes."""
    return squeezed(F.rtrim(text, F.lit("'s")) if as_coded else F.regexp_replace(text, "'s?$", ""))


def slug(folded: Column) -> Column:
    """CamelCase of a name that has been folded to ASCII; ``Unknown`` if nothing is left."""
    bare = squeezed(F.regexp_replace(folded, r"[^a-zA-Z0-9\x09-\x0D\x1C-\x20]", ""))
    return F.coalesce(F.nullif(F.replace(F.initcap(bare), F.lit(" "), F.lit("")), F.lit("")), F.lit("Unknown"))


def local_name(uri: Column) -> Column:
    """What follows the last # or, without one, the last /."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def any_word(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether the text contains one of the parts."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def mapped(key: Column, table: dict[str, str]) -> Column:
    """A small fixed table as an expression; null for other keys."""
    if not table:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
