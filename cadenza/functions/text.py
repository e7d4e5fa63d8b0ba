"""Text normalisation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalized(text, keep: str = "") -> Column:
    """Lower-cased text in which runs of characters other than letters, digits and ``keep`` are one space."""
    return F.lower(F.trim(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{keep}]+", " ")))


def blank(text) -> Column:
    """Whether a text is null or only spaces."""
    return text.isNull() | (F.trim(text) == "")


def ascii_key(text: str) -> str:
    """Accent-free lower-case ASCII words: compatibility-decomposed, with & spelled out."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return " ".join(re.findall(r"[a-z0-9]+", plain.casefold().replace("&", " and ")))


@F.pandas_udf(StringType())
def ascii_normalized(text: pd.Series) -> pd.Series:
    """``ascii_key`` of a column; Spark has no decomposition of its own. Null stays null."""
    return text.map(ascii_key, na_action="ignore")


def track_key(title, artist) -> Column:
    return F.concat(ascii_normalized(title), F.lit("\u0000"), ascii_normalized(artist))
