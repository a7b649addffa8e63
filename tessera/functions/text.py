"""Text functions as column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import BOILERPLATE, STOP_WORDS

#: Words as letters, digits and underscore of any script; Java's \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"


def ws_strip(col: Column) -> Column:
    """Without white space at both ends, of any kind; ``trim`` knows spaces only."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def collapse(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\s+", " ")


def clean_tokens(col: Column, stops: tuple[str, ...] | None = None) -> Column:
    """array<string>: lower case, no links, tags, marks, stop or short words."""
    text = F.lower(F.coalesce(col, F.lit("")))
    for pattern in (r"http\S+|www\.\S+", r"<.*?>", r"[^a-z\s]"):
        text = F.regexp_replace(text, pattern, " ")
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    kept = F.filter(words, lambda w: F.length(w) > 2)
    # array_except would drop repeats, so stop words go by membership in one hashed literal.
    return F.filter(kept, lambda w: ~w.isin(list(STOP_WORDS if stops is None else stops)))


def strip_boilerplate(col: Column) -> Column:
    for _, pattern in BOILERPLATE:
        col = F.regexp_replace(col, pattern, " ")
    return ws_strip(collapse(col))


def normalise(col: Column) -> Column:
    """Lower case, marks to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9 ]", " "), r"\s+", " "))


def n_words(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def text_stats(col: Column) -> dict[str, Column]:
    """The eleven stylometric numbers of a text; ratios of empty texts are 0."""
    chars, words = F.length(col).cast("long"), n_words(col)
    caps = F.regexp_count(col, F.lit(r"(?U)\b[A-Z]{2,}\b")).cast("long")

    def count(pattern: str) -> Column:
        return F.regexp_count(col, F.lit(pattern)).cast("long")

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    return {
        "n_chars": chars,
        "n_words": words,
        "n_sentences": F.greatest(count("[.!?]"), F.lit(1).cast("long")),
        "avg_word_len": share(F.length(F.regexp_replace(col, r"[^\p{L}\p{N}_]", "")), words),
        "exclamation_count": count("!"),
        "question_count": count(r"\?"),
        "quote_count": count('"'),
        "allcaps_words": caps,
        "allcaps_ratio": share(caps, words),
        "digit_ratio": share(count(r"\p{Nd}"), chars),
        "upper_char_ratio": share(count(r"\p{Lu}"), chars),
    }


def shingles(tokens: Column, width: int = 5, most: int | None = None) -> Column:
    """Distinct word shingles; a text of up to ``width`` words is one."""
    if most:
        tokens = F.slice(tokens, 1, most)
    n = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, width), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))


def word_ngrams(tokens: Column) -> Column:
    """Words and pairs of neighbours."""
    n = F.size(tokens)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))
    return F.concat(tokens, F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))


def char_ngrams(col: Column, low: int = 3, high: int = 5, most: int = 1500) -> Column:
    """Character n-grams within words padded by one space, case kept."""
    words = F.filter(F.split(F.substring(col, 1, most), r"\s+"), lambda w: w != "")

    def of(n: int) -> Column:
        def grams(w: Column) -> Column:
            padded = F.concat(F.lit(" "), w, F.lit(" "))
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: padded.substr(i, F.lit(n)))

        return F.transform(words, grams)

    return F.flatten(F.concat(*[of(n) for n in range(low, high + 1)]))


def excerpt(col: Column, pattern: str, around: int = 110) -> Column:
    """The stretch around the first match, white space as single spaces; the opening where nothing matches.

    Characters are counted as code points.  Dots stand for what is left out
    before it, and always end it.
    """
    text = collapse(F.coalesce(col, F.lit("")))
    start = F.greatest(F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1)) - around, F.lit(0))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, F.lit(2 * around)), F.lit("..."))


def parse_date(col: Column, formats: tuple[str, ...]) -> Column:
    """Timestamp by the first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(ws_strip(col), F.lit(f)) for f in formats])


def bucket(col: Column, bins) -> Column:
    """Label of the left-closed bin: (lower edge, label) in ascending order."""
    out = F.lit(None).cast("string")
    for edge, label in bins:
        out = F.when(col >= edge, label).otherwise(out)
    return out


def bucket_upper(col: Column, bins) -> Column:
    """Label of the right-closed bin: (upper edge, label) in ascending order."""
    out = F.lit(None).cast("string")
    for edge, label in reversed(bins):
        out = F.when(col <= edge, label).otherwise(out)
    return out
