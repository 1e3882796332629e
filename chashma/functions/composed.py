"""The deterministic text form: composed characters, one kind of blank, apostrophe and quote."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chashma.functions.text import flags, strip

# Fixed values.
BLANKS = "   "
INVISIBLE = "[­​⁠﻿]"
APOSTROPHES = "`´ʻʼ‘’′"
QUOTES = "“”„«»"


@F.pandas_udf(StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition, for which Spark has no function; ASCII texts never come here (see `compose`)."""
    import unicodedata

    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def compose(text: Column) -> Column:
    """NFC, where a text has a combining mark or a decomposable sign at all."""
    return F.when(text.rlike(r"[\p{M}̀-̈́ᄀ-ᇿΩKÅ豈-﫿]"), nfc(text)).otherwise(text)


def normal_form(text: Column) -> Column:
    t = F.translate(compose(text), BLANKS + APOSTROPHES + QUOTES, " " * len(BLANKS) + "'" * len(APOSTROPHES) + '"' * len(QUOTES))
    return strip(F.regexp_replace(F.regexp_replace(t, INVISIBLE, ""), " {2,}", " "))


def normal_form_flags(text: Column) -> Column:
    """What the form would change."""
    return flags(
        ("BLANK_VARIANT", text.rlike(f"[{BLANKS}]")), ("INVISIBLE", text.rlike(INVISIBLE)), ("APOSTROPHE_VARIANT", text.rlike(f"[{APOSTROPHES}]")), ("QUOTE_VARIANT", text.rlike(f"[{QUOTES}]")),
        ("REPEATED_SPACES", text.rlike(" {2,}")), ("OUTER_BLANKS", text.rlike(r"(?U)^\s|\s\z")),
    )
