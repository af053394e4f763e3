"""Documents dealt into chunks of bounded text, and the distinct words of each chunk.

A table about words (counts, encodings) that is too large for one worker reaches documents chunk by chunk: each chunk asks
for its own distinct words and gets back their rows beside its documents. Texts are shuffled once; a frequent word is one
row per chunk, however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosescan.llm.common import text_of

#: UTF-8 bytes of text in a chunk, about.
CHUNK_BYTES = 16_000_000


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk, doc_id, text."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    return own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", "text")
