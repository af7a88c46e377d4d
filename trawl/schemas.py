"""Schemas of the tables, in one place; nothing is ever inferred."""

from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType())
_PROPERTIES = T.MapType(T.StringType(), _TEXTS)


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, D, L = T.StringType(), T.DoubleType(), T.LongType()

RECORD = _table(id=S, schema=S, caption=S, datasets=_TEXTS, properties=_PROPERTIES)
ENTITY = _table(id=S, schema=S, caption=S, countries=_TEXTS, topics=_TEXTS, datasets=_TEXTS, properties=_PROPERTIES, search_text=S)
RELATION = _table(id=S, schema=S, source_id=S, target_id=S, role=S, properties=_PROPERTIES)
#: What every retriever returns: the ranked hits of each query.
RUN = _table(query_id=S, doc_id=S, score=D, rank=L)
QUERY = _table(id=S, family=S, query=S, relevant=_TEXTS, entity_caption=S)
DECISION = _table(key=S, query=S, match_id=S, confidence=S, reason=S)
