"""Language by markers or by url."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of the two languages.
ENGLISH = ("the", "and", "with", "for", "from", "health", "disease", "treatment", "patient", "study")
SPANISH = ("el", "la", "los", "las", "con", "para", "salud", "enfermedad", "tratamiento", "paciente")
SUPPORTED = ("en", "es")


def detect(text: Column, hint: Column | None = None) -> Column:
    """A supported hint wins; else the language with more markers, English on a tie, or unknown."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+")

    def count(markers: tuple) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*markers)))

    en, es = count(ENGLISH), count(SPANISH)
    found = F.when((en == 0) & (es == 0), "unknown").when(en >= es, "en").otherwise("es")
    return found if hint is None else F.when(hint.isin(*SUPPORTED), hint).otherwise(found)


def from_url(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    path = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    return F.when(F.contains(path, F.lit("/es/")) | F.contains(path, F.lit("/spanish/")) | F.contains(low, F.lit("lang=es")), "es").otherwise("en")
