"""Token counts: how many tokens a library gives each text, without keeping the ids.

Rows with null or empty text count 0 bytes and 0 tokens. Repeated rows each give
a row; an empty table gives none. Columns of the input other than the id and the
text are not read, so their names cannot clash. Very long texts need no more
memory at once than the text itself, as slices are cut by bytes and a text by
its pieces.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import sliced
from .tokens import SLICE_BYTES, token_counts


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each row; batches go to the library balanced by bytes, texts cut at safe places."""

    def run(batches):
        for part in sliced(batches, text_col, SLICE_BYTES, "tokens"):
            texts = part.column(text_col)
            counts = token_counts(vocabulary, texts)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(id_col), sizes, pa.array(counts), pa.array(counts > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
