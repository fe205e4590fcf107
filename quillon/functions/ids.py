"""Registry identifiers: normalisation, check digits, masks, stable buckets and keyed pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the two check digits, from the left.
FIRM_WEIGHTS = ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
PERSON_WEIGHTS = ([10, 9, 8, 7, 6, 5, 4, 3, 2], [11, 10, 9, 8, 7, 6, 5, 4, 3, 2])


def normalize_id(raw: Column) -> Column:
    """Upper case without other marks than letters and digits; 12 or 13 digits get zeros to 14, everything else stays as it is; null if nothing is left."""
    clean = F.regexp_replace(F.upper(raw), "[^0-9A-Z]", "")
    padded = F.when(clean.rlike(r"^[0-9]{12,13}\z"), F.lpad(clean, 14, "0")).otherwise(clean)
    return F.when(clean != "", padded)


def _digit(text: Column, weights: list[int], offset: int = 48) -> Column:
    """Mod-11 check digit; a character counts as its code less `offset`, so letters may occur."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(weights))),
        F.lit(0),
        lambda acc, i: acc + (F.ascii(F.substring(text, i, F.lit(1))) - offset) * F.element_at(F.lit(weights), i),
    )
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def firm_id_ok(identifier: Column) -> Column:
    """Whether a 14-character identifier has right check digits; false for other lengths, null for null."""
    shaped = identifier.rlike(r"^[0-9A-Z]{12}[0-9]{2}\z") & ~identifier.rlike(r"^(.)\1{13}\z")
    first, second = (_digit(identifier, w) for w in FIRM_WEIGHTS)
    right = (F.substring(identifier, 13, 1) == first.cast("string")) & (F.substring(identifier, 14, 1) == second.cast("string"))
    return F.when(shaped, right).otherwise(F.when(identifier.isNotNull(), F.lit(False)))


def person_id_ok(identifier: Column) -> Column:
    shaped = identifier.rlike(r"^[0-9]{11}\z") & ~identifier.rlike(r"^(.)\1{10}\z")
    first, second = (_digit(identifier, w) for w in PERSON_WEIGHTS)
    right = (F.substring(identifier, 10, 1) == first.cast("string")) & (F.substring(identifier, 11, 1) == second.cast("string"))
    return F.when(shaped, right).otherwise(F.when(identifier.isNotNull(), F.lit(False)))


def with_check_digits(root: Column) -> Column:
    """The 14-character identifier of a 12-character root."""
    first = F.concat(root, _digit(root, FIRM_WEIGHTS[0]).cast("string"))
    return F.concat(first, _digit(first, FIRM_WEIGHTS[1]).cast("string"))


def digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def firm_mask(identifier: Column) -> Column:
    return F.regexp_replace(identifier, r"^(.{2})(.{3})(.{3})(.{4})(.{2})$", r"$1.$2.$3/$4-$5")


def case_mask(raw: Column) -> Column:
    """Digits filled with zeros to 20, in the court's mask."""
    return F.regexp_replace(F.lpad(digits(raw), 20, "0"), r"^(\d{7})(\d{2})(\d{4})(\d)(\d{2})(\d{4})$", r"$1-$2.$3.$4.$5.$6")


def code(raw: Column, zero_is_null: bool = True) -> Column:
    """A trimmed code; blank is null, and all zeros too unless they are to be kept."""
    text = F.trim(raw)
    empty = (text == "") | (text.rlike(r"^0+\z") if zero_is_null else F.lit(False))
    return F.when(~empty, text)


def bucket(key: Column, n: int) -> Column:
    """A number below n from the key's md5, the same in every engine."""
    return F.pmod(F.conv(F.left(F.md5(key), F.lit(8)), 16, 10).cast("long"), F.lit(n))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed hash as hex; null stays null."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def person_key(name: Column, document: Column) -> Column:
    """Folded name and the document's visible digits."""
    from quillon.functions.text import fold_accents

    folded = F.regexp_replace(F.trim(F.upper(fold_accents(name))), r"\s+", " ")
    return F.concat_ws("|", folded, digits(document))
