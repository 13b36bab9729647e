"""Name and slug normalisation (rows F1-F3, F26, F27, F39)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

#: The annotations that a ballot prints after a name, in parentheses.
BALLOT_NOTES = ("withdrawn", "withdrew", "deceased", "disqualified", "incumbent", "write-in", "writein")
#: Party codes of federal candidate files.
PARTY_CODES = {"DEM": "democratic", "REP": "republican", "LIB": "libertarian", "GRE": "green", "IND": "independent", "NON": "nonpartisan"}


@F.pandas_udf(StringType())
def _casefolded(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in names:
        yield part.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()) or None, na_action="ignore")


def normalize_name(name: Column) -> Column:
    """NFKC, case fold, white space collapsed; blank gives null. Plain ASCII stays in the JVM."""
    plain = F.nullif(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), F.lit(""))
    return F.when(name.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(_casefolded(name))


def ascii_name(name: Column) -> Column:
    """F1 for names known to be ASCII: no Python at all."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), F.lit(""))


def slug(value: Column) -> Column:
    """lower case, every run of other characters a hyphen, none at the ends; empty gives null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


@F.pandas_udf(ArrayType(StringType()))
def folded_namespaces(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """F3 for arrays that hold more than ASCII: NFKC, case fold, no outer blanks."""
    fold = lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().casefold() or None
    for part in lists:
        yield part.map(lambda xs: [fold(x) for x in xs], na_action="ignore")


def namespace(value: Column) -> Column:
    """F3 for plain ASCII: lower case without outer blanks; empty gives null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))), F.lit(""))


def candidate_name(printed: Column) -> Column:
    """a printed name without ballot annotations."""
    notes = "|".join(BALLOT_NOTES)
    return F.trim(F.regexp_replace(F.regexp_replace(printed, rf"(?i)\s*\((?:{notes})\)", " "), r"\s+", " "))


def party_slug(code: Column) -> Column:
    """the name of a known party code, else the code itself in lower case; blank gives null."""
    known = F.create_map(*(F.lit(x) for pair in PARTY_CODES.items() for x in pair))
    return F.coalesce(F.element_at(known, F.upper(F.trim(code))), F.nullif(F.lower(F.trim(code)), F.lit("")))


def one_line(*parts: Column) -> Column:
    """the parts that are not blank, joined by a comma."""
    return F.concat_ws(", ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))
