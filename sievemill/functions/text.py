"""Text as column expressions: cleaning, normalising, tokens, fingerprints, snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Commonest English and Spanish function words, as used by the registered queries.
STOPWORDS = tuple(
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or our she so than that the their them then there they this to was we were what when which who will with you your "
    "al algo ante como con de del desde donde el ella en entre era es esa ese esta este fue ha hay la las le les lo los me mi muy no nos o para pero por que se ser si sin sobre su sus te tu un una uno y ya".split()
)
SPACES = r"[\s\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"
NOT_WORDS = r"[^\p{L}\p{N}_]+"


def load_stopwords(spark: SparkSession, languages: Sequence[str] = ("english", "spanish")) -> list[str]:
    """The lists that Spark ships, for languages by name."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({w for name in languages for w in StopWordsRemover.loadDefaultStopWords(name)})


def clean(text: Column) -> Column:
    """White space runs as one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def strip_tags(text: Column) -> Column:
    """Text without residual markup: tags become spaces, the common references are decoded, once."""
    t = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(t, r"(?is)<(script|style)[^>]*>.*?</\s*(script|style)\s*>", " "), r"(?s)<!--.*?-->|</?[a-zA-Z][^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.when(F.contains(t, F.lit("<")) | F.contains(t, F.lit("&")), bare).otherwise(t)


def normalize(text: Column) -> Column:
    """Lower case, all but word characters as spaces, white space collapsed."""
    return clean(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


def tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Words of the normalised text of two characters or more that are no stopwords."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORDS)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords) if stopwords else F.length(w) > 1)


def lexical(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    return tokens(strip_tags(text), stopwords)


def semantic(text: Column) -> Column:
    """Text for an encoder: markup gone, white space collapsed, case and marks kept."""
    return clean(strip_tags(text))


def indexed_text(title: Column, content: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(content, F.lit("")))


def fingerprint(text: Column) -> Column:
    """SHA-1 of the lower-cased words with single spaces."""
    return F.sha1(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORDS, " ")))


def snippet(text: Column, size: int = 300, always: bool = False) -> Column:
    """The first ``size`` characters and dots: only if there is more, or always."""
    t = F.coalesce(text, F.lit(""))
    cut = F.concat(F.substring(t, 1, size), F.lit("..."))
    return cut if always else F.when(F.length(t) > size, cut).otherwise(t)


def fix_mojibake(text: Column) -> Column:
    """UTF-8 read as Latin-1, read right again; other text stays as it is."""
    again = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    fits = F.decode(F.encode(text, "ISO-8859-1"), "ISO-8859-1") == text
    return F.when(fits & F.rlike(text, F.lit("[ÂÃ][\u0080-¿]")) & ~F.contains(again, F.lit("�")), again).otherwise(text)
