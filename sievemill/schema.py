"""Schemas of the engine's tables."""

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _L = StringType(), LongType()

#: Accepted documents, of either generation: the older one has no language and no fetch time.
DOCUMENT = _struct(id=_L, title=_S, content=_S, source=_S, url=_S, category=_S, language=_S, fetched_at=_S)
#: Rejected records in all their shapes: a url and reason, with a language, or whole documents.
REJECTED = _struct(url=_S, reason=_S, language=_S, id=_L, title=_S, content=_S, source=_S, category=_S, fetched_at=_S, rejection_reason=_S)
RAW_PAGE = _struct(url=_S, html=_S, source=_S, fetched_at=_S)
POSTING = _struct(term=_S, doc_id=_L, tf=_L, dl=_L)
VECTOR = _struct(doc_id=_L, embedding=ArrayType(FloatType()), unit=ArrayType(DoubleType()))
HIT = _struct(query_id=_L, doc_id=_L, score=DoubleType(), rank=IntegerType())
SEED = _struct(url=_S, language_hint=_S, source_name=_S, category_hint=_S, allowed_domains=ArrayType(_S))
FRONTIER = _struct(url=_S, depth=IntegerType(), language_hint=_S, source_name=_S, category_hint=_S, domain_scope=_S, allowed_domains=ArrayType(_S))
