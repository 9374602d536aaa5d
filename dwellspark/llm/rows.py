"""Shared column helpers: whole input rows beside working columns, ASCII words, hash pairs."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

#: The ASCII white space that separates words and is cut from lines.
BLANKS = " \t\n\x0b\f\r"


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def pack(df: DataFrame, **working: str) -> DataFrame:
    """Working columns under fixed names, and all other columns out of their way in ``rest``.

    An input column may then have any name without clashing with one that an operator adds.
    """
    others = [column(name) for name in df.columns if name not in working.values()]
    rest = F.struct(*others) if others else F.struct(F.lit(True).alias("none"))
    return df.select(*[column(name).alias(to) for to, name in working.items()], rest.alias("rest"))


def unpack(df: DataFrame, like: DataFrame, working: dict[str, str], **made: Column) -> DataFrame:
    """The columns of ``like`` again, then those made; a made column replaces an input column of its name."""
    back = {name: to for to, name in working.items()}
    kept = [
        (F.col(back[name]) if name in back else F.col("rest").getField(name)).alias(name)
        for name in like.columns
        if name not in made
    ]
    return df.select(*kept, *[value.alias(name) for name, value in made.items()])


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does that at once for texts that are all ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def hash_pair(value: Column) -> list[Column]:
    """128 bits in two columns: with 64, equal hashes of unequal values must be expected from 10^10 rows on."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit("second"), value).alias("h2")]
