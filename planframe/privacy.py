"""Personal data in text, and a gate for text that leaves: it must not repeat values of private columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import values as V

#: What counts as personal data, and how it is called.
PATTERNS = {
    "a PAN number": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "an Aadhaar number": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "a phone number": r"(?:\+?91[\s-]?)?\b[6-9]\d{9}\b",
    "an e-mail address": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "a card or account number": r"\b\d{11,19}\b",
}
#: Characters of a secret value and of a secret word at least, and the least secret whole number.
VALUE_CHARACTERS, WORD_CHARACTERS, LEAST_NUMBER = 3, 4, 1000


def personal_data(text: Column) -> Column:
    """Array of the kinds found in a text, in the order of PATTERNS; empty where there are none. Words end at other than ASCII letters."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", " ")
    return F.array_compact(F.array(*[F.when(plain.rlike(p), F.lit(n)) for n, p in PATTERNS.items()]))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}@._-]+"), lambda t: t != "")


def secrets(df: DataFrame, columns: list[str], allowed: list[str] | None = None) -> DataFrame:
    """secret: distinct values of three characters or more of these columns and their words of four or more, lower case.

    Whole numbers count from 1,000 on. Column names, their words and ``allowed`` are never secret.
    """
    parts = []
    for c in columns:
        x = V.col(c)
        if V.kind_of(df, c) == "number":
            parts.append(F.when((x == F.floor(x)) & (F.abs(x) >= LEAST_NUMBER), F.array(V.text_of(x, "number"))))
        else:
            low = F.lower(V.strip(V.text_of(x, V.kind_of(df, c))))
            parts.append(F.when(F.length(low) >= VALUE_CHARACTERS, F.concat(F.array(low), F.filter(tokens(low), lambda t: F.length(t) >= WORD_CHARACTERS))))
    held = df.select(F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*parts))))).alias("secret")).distinct()
    names = df.sparkSession.createDataFrame([(c.lower(),) for c in [*df.columns, *(allowed or [])]], "name string")
    shown = names.select(F.explode(F.concat(F.array("name"), tokens(F.col("name")))).alias("secret"))
    return held.join(shown, "secret", "left_anti")


def leaks(texts: DataFrame, key: str, text: str, secret: DataFrame) -> DataFrame:
    """key, found: texts with personal data or with a secret value or word, and what was found; a join on words."""
    low = F.lower(V.strip(V.col(text)))
    words = texts.select(V.col(key), F.explode(F.array_distinct(F.concat(F.array(low), tokens(low)))).alias("secret")).filter("secret <> ''")
    told = words.join(secret, "secret", "left_semi").select(V.col(key), F.lit("a value from your file").alias("found")).distinct()
    kinds = texts.select(V.col(key), F.explode(personal_data(V.col(text))).alias("found"))
    both = kinds.unionByName(told)
    return both.groupBy(V.col(key)).agg(F.array_sort(F.collect_set("found")).alias("found"))
