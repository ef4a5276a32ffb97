"""Step 1: cleaning, content hash, language heuristic and quality gate, as column expressions.

Only character references and compatibility forms have no native function; one Arrow UDF does both and returns
plain ASCII text without ``&`` untouched.  All other rules stay inside the JVM.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and word lists of the quality rules.
# (each pattern beside a piece of lower-case text that every match holds).
_BOILERPLATE = (
    (r"\bread more\b", "read more"),
    (r"\bread less\b", "read less"),
    (r"\bshow more\b", "show more"),
    (r"the media could not be loaded\.?", "the media could"),
    (r"\d+ (?:people|person) found this helpful", "found this helpful"),
    (r"helpful\s*\|\s*report abuse", "report abuse"),
    (r"\breport abuse\b", "report abuse"),
    (r"\bverified purchase\b", "verified purchase"),
    (r"reviewed in [^\n]{0,40} on \w+ \d{1,2}, \d{4}", "reviewed in"),
    (r"colou?r:\s*[^|\n]{1,40}\|", "r:"),
    (r"\bsize:\s*[^|\n]{1,40}\|", "size:"),
    (r"see more reviews", "see more reviews"),
    (r"translated from \w+", "translated from"),
    (r"originally posted in \w+", "originally posted in"),
)
_URL = r"https?://\S+|www\.\S+"
_EMAIL = r"\S+@\S+\.\S+"
_INVISIBLE = "[\u200b-\u200f\u2028\u2029\ufeff\u00ad]"
_GENERIC = (
    "good", "nice", "ok", "okay", "bad", "great", "awesome", "super", "excellent", "worst", "best", "fine", "average", "yes", "no", "n/a", "na", "none", "nothing",
    "cool", "wow", "thanks", "thank you", "good product", "nice product", "very good", "very nice", "good one", "best product", "value for money", "as expected",
    "not bad", "love it", "worth it",
)
_ENGLISH = (
    "the", "and", "is", "it", "this", "for", "with", "but", "very", "good", "phone", "battery", "camera", "not", "was", "have", "great", "you",
)


def _decode(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", html.unescape(t)) for t in texts], index=texts.index, dtype=object)


_decode.__annotations__ = {"texts": pd.Series, "return": pd.Series}


def strip_html(text: Column) -> Column:
    """Tags become blanks, then references are decoded (so an escaped tag survives as text)."""
    plain = F.regexp_replace(text, "<[^>]+>", " ")
    # nothing changes in ASCII text without "&": only the others are sent to Python
    other = F.when(F.regexp_like(plain, F.lit(r"[&[^\x00-\x7F]]")), plain)
    return F.coalesce(F.pandas_udf(_decode, "string")(other), plain)


def _blanked(text: Column, pattern: str, *parts: str) -> Column:
    """Matches become blanks; texts that hold none of ``parts`` (in lower case) are spared the search."""

    def one(t: Column) -> Column:
        may = F.lit(False)
        for part in parts:
            may = may | F.contains(F.lower(t), F.lit(part))
        return F.when(may, F.regexp_replace(t, pattern, " ")).otherwise(t)

    # a one-element array names the value, which is used twice
    return F.transform(F.array(text), one)[0]


def normalise_text(text: Column) -> Column:
    """Cleaned text; null becomes empty."""
    out = F.regexp_replace(strip_html(F.coalesce(text, F.lit(""))), _INVISIBLE, "")
    out = _blanked(out, f"(?U){_URL}", "://", "www.")
    out = _blanked(out, f"(?U){_EMAIL}", "@")
    for pattern, part in _BOILERPLATE:
        out = _blanked(out, f"(?iU){pattern}", part)
    out = F.translate(out, "\u2019\u2018\u201c\u201d\u2013\u2014", "''\"\"--")
    out = F.regexp_replace(out, r"([^\n])\1{3,}", "$1$1")
    out = F.regexp_replace(out, r"([!?.,])\1+", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), "^ | $", "")


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def content_hash(text: Column) -> Column:
    """Texts that differ only in case, marks and spacing share it."""
    return F.sha2(canonical(text), 256)


def heuristic_language(text: Column) -> Column:
    """``en`` for mostly ASCII text with two common words, else null."""
    low = F.lower(text)
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-z']+)"), F.lit(1)))
    letters = F.length(F.regexp_replace(low, "[^a-z]", ""))
    common = F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in _ENGLISH))))
    return F.when((F.length(low) > 0) & (letters > 0) & (letters >= 0.4 * F.length(low)) & (common >= 2), F.lit("en"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _letters(text: Column, kind: str = "L") -> Column:
    """How many characters of a kind a text has: what lies between them goes, run by run."""
    return F.length(F.regexp_replace(text, rf"\P{{{kind}}}+", ""))


def _two_letters(dense: Column) -> Column:
    """Whether a text is made of at most two different characters."""
    without = lambda t: F.replace(t, F.substring(t, 1, 1), F.lit(""))
    return without(without(dense)) == ""


def with_spam_reason(df: DataFrame, text: str, raw: str | None = None, name: str = "spam_reason") -> DataFrame:
    """``df`` with the first quality rule that a cleaned text breaks, or null.  ``raw``: the text before cleaning.

    What several rules look at (words, letters) is projected once.
    """
    low = F.regexp_replace(F.lower(text), r"^[ .!?]+|[ .!?]+$", "")
    step = df.withColumns({"_low": low, "_words": F.regexp_extract_all(low, F.lit(r"([a-z']+)"), F.lit(1))})
    out = F.when(F.col("_low").isin(*_GENERIC), "generic_only")
    if raw is not None:
        step = step.withColumns({"_dense": F.lower(F.regexp_replace(raw, r"(?U)\s+", "")), "_letters": _letters(F.col(raw))})
        out = out.when((F.length("_dense") >= 12) & _two_letters(F.col("_dense")), "repeated_chars")
        out = out.when((F.col("_letters") > 25) & (_letters(F.col(raw), "IsUppercase") > 0.8 * F.col("_letters")), "all_caps")
    n = F.size("_words")
    out = (
        out.when(n == 0, "no_alpha_content")
        .when((n >= 6) & (F.size(F.array_distinct("_words")) < 0.3 * n), "low_lexical_diversity")
        .when(_letters(F.col(text)) < 0.45 * F.greatest(F.length(text), F.lit(1)), "low_alpha_ratio")
        .when(_count(F.col(text), f"(?U){_URL}") >= 2, "link_spam")
    )
    return step.withColumn(name, out).drop("_low", "_words", "_dense", "_letters")


def combined(title: Column, body: Column) -> Column:
    """The cleaned title before the cleaned body, unless the body opens with it."""
    opens = F.startswith(F.lower(body), F.substring(F.lower(title), 1, 30))
    joined = F.trim(F.concat(F.regexp_replace(title, "[.!?]+$", ""), F.lit(". "), body))
    return F.when((title != "") & ~opens, joined).otherwise(body)


def preprocess(reviews: DataFrame, body: str = "body", title: str | None = "title", min_chars: int = 15, language: str | None = "en", detector=heuristic_language) -> DataFrame:
    """``reviews`` with cleaned_body, content_hash, language, is_spam, excluded_reason and usable.

    Order of the verdicts: empty, spam rules, too_short, language_filtered.  The language is only set when
    reached.  ``detector`` maps the cleaned text column to a language column.
    """
    raw_title = F.coalesce(F.col(title), F.lit("")) if title else None
    raw_body = F.coalesce(F.col(body), F.lit(""))
    # each cleaning chain is projected once, so that later expressions read a column
    step = reviews.withColumns({"_b": normalise_text(raw_body), "_raw": F.trim(raw_body if raw_title is None else F.concat(raw_title, F.lit(" "), raw_body))})
    if raw_title is None:
        step = step.withColumnRenamed("_b", "cleaned_body")
    else:
        step = step.withColumn("_t", normalise_text(raw_title)).withColumn("cleaned_body", combined(F.col("_t"), F.col("_b")))
    step = with_spam_reason(step, "cleaned_body", "_raw", "_spam").withColumn("_spam", F.when(F.col("cleaned_body") != "", F.col("_spam")))
    short = F.length("cleaned_body") < min_chars
    fine = (F.col("cleaned_body") != "") & F.col("_spam").isNull() & ~short
    step = step.withColumn("language", F.when(fine, detector(F.col("cleaned_body"))))
    reason = F.when(F.col("cleaned_body") == "", "empty").when(F.col("_spam").isNotNull(), F.col("_spam")).when(short, "too_short")
    if language:
        reason = reason.when(~F.col("language").eqNullSafe(F.lit(language)), "language_filtered")
    step = step.withColumns({"content_hash": content_hash(F.col("cleaned_body")), "is_spam": F.col("_spam").isNotNull(), "excluded_reason": reason})
    step = step.withColumn("usable", ~F.col("is_spam") & F.col("excluded_reason").isNull() & (F.col("cleaned_body") != ""))
    return step.drop("_t", "_b", "_raw", "_spam")
