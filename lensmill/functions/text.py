"""Column builders on text, times and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that is not white space, by Unicode; plain trim would leave line ends and wide spaces.
NOT_BLANK = r"(?U)\S"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_blank(c: Column | str) -> Column:
    """False for null and for texts of nothing but white space."""
    return F.coalesce(col(c).rlike(NOT_BLANK), F.lit(False))


def text_key(c: Column | str) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text: the key by which texts meet their vectors."""
    return F.sha2(col(c), 256)


def rank_key(seed: int, purpose: str, c: Column | str) -> Column:
    """Order of an id in a reproducible draw: SHA-256 over the seed (8 bytes, little-endian), the purpose and the id.

    Hex digits compare as the bytes do.
    """
    prefix = seed.to_bytes(8, "little").hex()
    return F.sha2(F.concat(F.unhex(F.lit(prefix)), F.lit(purpose).cast("binary"), col(c).cast("binary")), 256)


def year_month(c: Column | str) -> Column:
    """``yyyy-MM`` in UTC of Unix seconds, also before 1970; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(col(c)), "yyyy-MM")


def month_name(c: Column | str) -> Column:
    """``2024-02`` as ``Feb 2024``; what is no month passes through."""
    return F.when(col(c).rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.date_format(F.try_to_timestamp(F.concat(col(c), F.lit("-01")), F.lit("yyyy-MM-dd")), "MMM yyyy")).otherwise(col(c))


def day_name(c: Column | str) -> Column:
    """``14 November 2023`` of Unix seconds; ``unknown`` for 0, less and null."""
    return F.when(col(c) > 0, F.date_format(F.timestamp_seconds(col(c)), "d MMMM yyyy")).otherwise(F.lit("unknown"))


def embedding_text(label: Column | str, description: Column | str) -> Column:
    return F.concat(col(label), F.lit(". "), col(description))


def review_url(author: Column | str, appid: Column | str, base: str) -> Column:
    """Address of a review, null without an author."""
    return F.when(col(author) != "", F.format_string(base + "/profiles/%s/recommended/%d/", col(author), col(appid)))


def folded(c: Column | str, most: int = 320) -> Column:
    """Whether a text is long enough to be folded on a page."""
    return F.char_length(F.trim(col(c))) > most


def bits_to_ids(mask: Column | str, ids: tuple[str, ...]) -> Column:
    """The ids whose bits are set, in slot order."""
    pairs = F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.lit(name).alias("id")) for k, name in enumerate(ids)])
    return F.transform(F.filter(pairs, lambda p: p["bit"].bitwiseAND(col(mask)) != 0), lambda p: p["id"])
