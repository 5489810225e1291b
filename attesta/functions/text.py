"""Scalar text functions on columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DASHES = "‐‑‒–—―−"
SPACES = "              　"


def nonblank(c: Column) -> Column:
    """NULL for NULL, empty and blank text."""
    return F.when(F.trim(c) != "", c)


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def norm_text(c: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed; '' for NULL."""
    return F.lower(F.trim(F.regexp_replace(text_of(c), r"\s+", " ")))


def norm_predictor(c: Column) -> Column:
    """Lower-case words of letters and digits, single-spaced."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


#: Characters that the compatibility form keeps and that do not combine: ASCII, most of Latin-1 and Latin Extended-A, plain punctuation.
STABLE = r"\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u2010\u2012-\u2015\u2018-\u201F"


_STABLE_BEYOND_ASCII = r"\x80" + STABLE.removeprefix(r"\x00")


def unstable(c: Column) -> Column:
    """Texts that the compatibility form may change. ASCII texts are told by their length; of others the runs of ASCII are
    passed over without trying each range of STABLE on each letter."""
    stable = c.rlike(rf"\A[\x00-\x7F]*+(?:[{_STABLE_BEYOND_ASCII}]++[\x00-\x7F]*+)*+\z")
    return F.when(F.octet_length(c) == F.length(c), False).otherwise(~stable)


def nfkc(c: Column) -> Column:
    """Unicode compatibility form; only texts with characters that are not STABLE leave the JVM, in Arrow batches."""
    odd = unstable(c)
    return F.when(odd, _nfkc(F.when(odd, c))).otherwise(c)


def norm_anchor(c: Column) -> Column:
    """NFKC, exotic spaces and dashes made plain, thousands commas removed, collapsed, lower-cased."""
    return norm_compatible(nfkc(text_of(c)))


def norm_compatible(c: Column) -> Column:
    """The same for a text that is in its compatibility form."""
    plain = F.when(F.octet_length(c) > F.length(c), F.translate(c, SPACES + DASHES, " " * len(SPACES) + "-" * len(DASHES))).otherwise(c)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?<=\d),(?=\d{3})", ""), r"\s+", " ")))


def norm_field(c: Column, ascii_only: bool = False) -> Column:
    """NFKC, dashes unified, lower case, year ranges with a hyphen, trailing punctuation dropped.

    ascii_only: for texts that are known to have no other letters, which then stay in the JVM as a whole column; the
    patterns run on those that have anything for them.
    """
    own = text_of(c) if ascii_only else F.translate(nfkc(text_of(c)), DASHES, "-" * len(DASHES))
    plain = F.lower(F.trim(own))
    ranged = F.regexp_replace(plain, r"(\d{4})\s*to\s*(\d{4})", "$1-$2")
    out = F.regexp_replace(F.regexp_replace(ranged, r"\s+", " "), "[.,;:]+$", "")
    return F.when(plain.rlike(r"\s|\dto\d|[.,;:]$"), out).otherwise(plain) if ascii_only else out


def norm_id_loose(c: Column) -> Column:
    """Lower case without parentheses' content and without anything but letters and digits."""
    low = F.lower(text_of(c))
    return F.when(low.rlike("[^a-z0-9]"), F.regexp_replace(F.regexp_replace(low, r"\([^)]*\)", " "), "[^a-z0-9]+", "")).otherwise(low)


def numeric_tokens(c: Column) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit(r"\d+\.?\d*"), F.lit(0))


def effect_tokens(c: Column) -> Column:
    """Numbers with an optional leading '<', spaces dropped."""
    found = F.regexp_extract_all(text_of(c), F.lit(r"<\s*\d+(?:\.\d+)?|\d+(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit("")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(c: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of distinct words: both empty 1, one empty 0."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * common / both)


def relevance(question: Column, row: Column) -> Column:
    """Common words over the root of all words; 0 if either has none."""

    def tokens(c: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z][a-z0-9_-]+"), F.lit(0)))

    q, r = tokens(question), tokens(row)
    score = F.size(F.array_intersect(q, r)) / (F.sqrt(F.size(F.array_union(q, r)).cast("double")) + 1e-9)
    return F.when((F.size(q) == 0) | (F.size(r) == 0), 0.0).otherwise(score)


def group_label(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike("non.?survivor|died"), "Non-survivors").when(low.rlike("survivor|alive"), "Survivors")


def section_priority(c: Column) -> Column:
    low = F.lower(text_of(c))
    return F.when(low.contains("table"), 1).when(low.contains("fig"), 2).when(low.rlike("result|body|method"), 3).otherwise(4)


def cohort_size(c: Column) -> Column:
    """First integer once commas are gone, else 0."""
    digits = F.regexp_extract(F.replace(text_of(c), F.lit(","), F.lit("")), r"\d+", 0)
    return F.coalesce(F.concat(F.lit("0"), digits).try_cast("long"), F.lit(0))  # no failing cast where there are no digits


def year_of_stem(c: Column) -> Column:
    year = F.regexp_extract(text_of(c), r"_(\d{4})(_|$)", 1).try_cast("int")
    return F.when(year.between(1900, 2099), year)


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.pdf$", "")


def norm_doi(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text_of(c))), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def norm_dataset(c: Column) -> Column:
    """Label without citation, version and year suffix."""
    s = F.lower(F.trim(text_of(c)))
    for pattern in (r"\([^)]*\)|\[[^\]]*\]", r"\s+v?\d+(\.\d+)+\s*$", r"[\s_-]+(19|20)\d{2}\s*$", r"\s+v\d+\s*$"):
        s = F.trim(F.regexp_replace(s, pattern, ""))
    return F.regexp_replace(s, r"[^a-z0-9]+", "-")


def bbox_text(c: Column) -> Column:
    """Four numbers in any text form, as 'x0,y0,x1,y1' with two places; NULL unless there are four."""
    n = F.regexp_extract_all(text_of(c), F.lit(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"), F.lit(0))
    return F.when(F.size(n) == 4, F.array_join(F.transform(n, lambda x: F.format_string("%.2f", x.cast("double"))), ","))


def fixed(c: Column, digits: int = 3) -> Column:
    return F.when(c.isNull(), "").otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def interval(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNull() | hi.isNull(), "").otherwise(F.format_string("%.2f-%.2f", lo, hi))


def source(paper: Column, page: Column) -> Column:
    named = text_of(paper)
    return F.when((named != "") & page.isNotNull(), F.concat(named, F.lit(" p."), page.cast("string"))).otherwise(named)
