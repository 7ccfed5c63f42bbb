"""Address and name normalisation as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _latin_folding() -> tuple[str, str]:
    """Accented Latin letters and their plain form, taken from Unicode decompositions."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        folded = "".join(
            c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(folded) == 1 and folded.isascii() and folded != chr(code):
            accented.append(chr(code))
            plain.append(folded)
    return "".join(accented), "".join(plain)


def _windows_letters() -> tuple[str, str]:
    """Control codes 0x80-0x9F as read in ISO 8859-1, and what Windows-1252 means by them."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, w in pairs if w), "".join(w for _, w in pairs if w)


_ACCENTED, _PLAIN = _latin_folding()
_LATIN1, _WINDOWS = _windows_letters()


def from_latin1(col: Column) -> Column:
    """Windows-1252 text that was read as ISO 8859-1, which Spark's readers accept."""
    return F.translate(col, _LATIN1, _WINDOWS)


def to_latin1(col: Column) -> Column:
    return F.translate(col, _WINDOWS, _LATIN1)


def lookup(col: Column, table: dict[str, str]) -> Column:
    """Value of a small literal map, null when the key is missing."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def fold_upper(col: Column) -> Column:
    folded = F.regexp_replace(F.translate(col, _ACCENTED, _PLAIN), r"\p{Mn}", "")
    return F.upper(folded)


def norm_token(col: Column) -> Column:
    spaced = F.regexp_replace(fold_upper(F.coalesce(col, F.lit(""))), "[^A-Z0-9]+", " ")
    return F.trim(spaced)


def norm_street(col: Column) -> Column:
    words = F.split(norm_token(col), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(lookup(w, K.STREET_WORDS), w)), " ")


def bare_subunit(token: Column) -> Column:
    """A normalised sub-unit without the words that name its kind."""
    prefix = r"^((" + "|".join(K.SUBUNIT_WORDS) + r")\b\s*)+"
    return F.trim(F.regexp_replace(token, prefix, ""))


def norm_subunit(col: Column) -> Column:
    return bare_subunit(norm_token(col))


def norm_postcode(col: Column) -> Column:
    return F.regexp_replace(fold_upper(F.coalesce(col, F.lit(""))), r"[\s-]+", "")


def postcode_parts(pc: Column) -> dict[str, Column]:
    """(area, outcode, sector) of a normalised postcode; blanks when it is not UK-shaped."""
    outcode = F.regexp_extract(pc, r"^(.+)\d..$", 1)
    area = F.regexp_replace(F.substring(outcode, 1, 2), r"[^\p{L}]", "")
    ok = (F.length(pc) >= 5) & (outcode != "") & (area != "")
    blank = F.lit("")
    return {
        "area": F.when(ok, area).otherwise(blank),
        "outcode": F.when(ok, outcode).otherwise(blank),
        "sector": F.when(ok, F.concat(outcode, F.lit(" "), F.substring(pc, -3, 1))).otherwise(blank),
    }


def pretty_postcode(pc: Column) -> Column:
    spaced = F.regexp_replace(pc, r"^(.+)(.{3})$", "$1 $2")
    return F.when(F.length(pc) < 5, pc).otherwise(spaced)


def property_key(postcode: Column, paon: Column, saon: Column, street: Column,
                 town: Column, extra: Column | None = None) -> Column:
    """Dwelling identity over normalised parts; the town counts only without a postcode."""
    return key_of_parts(norm_postcode(postcode), norm_token(paon), norm_token(saon), norm_street(street), norm_token(town),
                        norm_token(extra) if extra is not None else None)


def key_of_parts(postcode: Column, paon: Column, saon: Column, street: Column, town: Column, extra: Column | None = None) -> Column:
    """The same from parts that are normalised already, null or blank where unknown."""
    def known(part):
        return F.coalesce(part, F.lit(""))
    parts = [known(postcode), known(paon), bare_subunit(known(saon)), known(street),
             F.when(known(postcode) == "", known(town)).otherwise(F.lit("")), known(extra) if extra is not None else F.lit("")]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def parcel_key(parcel: Column, kind: Column, area: Column, rooms: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (parcel, kind, area, rooms)]
    return F.md5(F.concat_ws("|", *parts))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def display_address(saon: Column, paon: Column, street: Column) -> Column:
    """`Flat 2, 12 High Street`; missing parts are left out, null when nothing is known."""
    house = blank_to_null(F.concat_ws(" ", blank_to_null(paon), blank_to_null(street)))
    line = F.concat_ws(", ", blank_to_null(saon), house)
    return F.initcap(blank_to_null(line))


def name_key(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, "[^a-zA-Z0-9]", ""))


def trigrams(col: Column) -> Column:
    """Distinct three-letter pieces of each padded word, the usual text-similarity set."""
    words = F.filter(F.split(F.lower(col), r"[^a-z0-9]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1),
        lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))
