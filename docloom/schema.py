"""Tables of the data model and the domains of their values."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _i, _b, _t = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _table(required: str, **columns: T.DataType) -> T.StructType:
    must = required.split()
    return T.StructType([T.StructField(n, t, n not in must) for n, t in columns.items()])


#: Metadata is a flat map; merges are shallow and the right side wins.
METADATA = T.MapType(_s, _s)
COLLECTIONS = _table("id name created_at updated_at", id=_s, name=_s, description=_s, created_at=_t, updated_at=_t)
DOCUMENTS = _table(
    "id collection_id title status created_at updated_at", id=_s, collection_id=_s, title=_s, file_path=_s, content_type=_s, file_size=_l, source_url=_s, status=_s,
    error_message=_s, metadata=METADATA, created_at=_t, processed_at=_t, updated_at=_t, source_quality=_s, framework=_s, framework_version=_s,
)
CHUNKS = _table("doc_id chunk_index text", id=_l, doc_id=_s, chunk_index=_i, text=_s, token_count=_i, embedding=T.ArrayType(T.FloatType()), embedding_model=_s, metadata=METADATA, created_at=_t)
API_USAGE = _table("provider operation tokens_used cost_usd created_at", provider=_s, operation=_s, tokens_used=_l, cost_usd=T.DecimalType(10, 4), collection_id=_s, user_id=_s, created_at=_t, metadata=METADATA)
BUDGET_ALERTS = _table("alert_type period triggered_at", alert_type=_s, threshold_usd=T.DecimalType(10, 2), current_spend_usd=T.DecimalType(10, 4), period=_s, triggered_at=_t, acknowledged=_b)

# Fixed values.
STATUSES = ("pending", "extracting", "chunking", "embedding", "complete", "error")
DIMENSION = 768
SEED_COLLECTIONS = tuple(f"00000000-0000-0000-0000-00000000000{i}" for i in (1, 2, 3))
