"""Small forms of SQL that the city's tables are cleaned with, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters that look like Cyrillic ones, and those (fixed values).
LATIN, CYRILLIC = "abcehikmoptxy", "авсенікмортху"
#: Kinds of streets as addresses shorten them (fixed values).
STREET_KINDS = ("бул", "ул", "пл", "жк", "кв", "ж к", "улица", "булевард", "площад", "квартал")
#: Roman numerals up to thirty, made by rule.
ROMAN = {
    n: "x" * (n // 10) + ("ix" if n % 10 == 9 else "iv" if n % 10 == 4 else "v" * (n % 10 // 5) + "i" * (n % 10 % 5)) for n in range(1, 31)
}


def look_alike(text: Column) -> Column:
    """Lower case, with Latin letters that look like Cyrillic ones replaced, if a Cyrillic letter is there."""
    low = F.lower(text)
    return F.when(low.rlike(r"\p{IsCyrillic}"), F.translate(low, LATIN, CYRILLIC)).otherwise(low)


def street_key(text: Column) -> Column:
    """A street's name without its kind, signs and blanks, Roman numerals as numbers, look-alike letters as one."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    kinds = "|".join(sorted(STREET_KINDS, key=len, reverse=True))
    bare = F.regexp_replace(spaced, rf"^({kinds}) (?=.)", "")
    numbered = F.transform(F.split(bare, " "), lambda w: F.coalesce(F.try_element_at(_roman(), w), w))
    return F.nullif(look_alike(F.array_join(numbered, "")), F.lit(""))


def _roman() -> Column:
    return F.create_map(*[F.lit(x) for n, r in ROMAN.items() for x in (r, str(n))])


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounding of doubles with halves to the even neighbour."""
    return F.bround(value, digits)


def day_of(text: Column) -> Column:
    """A date from DD.MM.YYYY, from ISO text or from a day number of 1899; null for all else."""
    bare = F.trim(text)
    dotted = F.when(bare.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(bare, "d.M.yyyy"))
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(bare, 1, 10), "yyyy-MM-dd"))
    serial = F.when(bare.rlike(r"^\d{5}$"), F.date_add(F.lit("1899-12-30").cast("date"), bare.cast("int")))
    return F.coalesce(dotted, iso, serial)


def json_kind(text: Column, path: str = "$") -> Column:
    """object, array, string, number, boolean or null for what a JSON text has at a path; null if nothing is there."""
    found = F.try_parse_json(text)
    kind = F.schema_of_variant(F.try_variant_get(found, path, "variant"))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def whole_array(text: Column, separator: str = ",") -> Column:
    """An array of whole numbers from separated text; parts that are none are left out."""
    return F.array_compact(F.transform(F.split(text, separator), lambda x: F.trim(x).try_cast("long")))
