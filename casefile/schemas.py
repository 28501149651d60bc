"""Fixed schemas of the library's tables; nothing is inferred."""

from pyspark.sql import types as T

_s, _i, _l, _t = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


DECISIONS = _struct(id=_s, number=_s, year=_s, dtype=_s, pdf_url=_s, source_date=_s, raw_json=_s, status=_s, text_chars=_i, n_chunks=_l, scraped_at=_t, ingested_at=_t)
CHUNKS = _struct(decision_id=_s, idx=_i, page=_i, text=_s, vec=T.ArrayType(T.FloatType()))
PAGES = _struct(decision_id=_s, page=_i, text=_s)
CHATS = _struct(id=_l, title=_s, owner=_s, created_at=_t, updated_at=_t)
SOURCE = _struct(number=_s, year=_s, type=_s, pdf_url=_s, title=_s)
MESSAGES = _struct(id=_l, chat_id=_l, role=_s, content=_s, sources=_s, created_at=_t)
FEED = _struct(recordsTotal=_l, data=T.ArrayType(T.ArrayType(_s)))
TOKEN_LINES = _struct(turn_id=_l, seq=_l, ts=_t, line=_s)
KEYSTROKES = _struct(user_id=_l, seq=_l, ts=_t, text=_s)
EVENTS = _struct(turn_id=_l, seq=_l, ts=_t, token=_s, sources=_s)
