"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file's path is a parameter (``LEXIFORGE_TOKENIZER`` or the argument); it must exist on every worker and is
read once in each. Whole texts are counted.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from lexiforge.runtime import env_path

TOKENIZER = env_path("LEXIFORGE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published split pattern of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    name = "public-" + hashlib.sha256(data).hexdigest()[:12]
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Adds the number of tokens of ``text``; null text has none (0)."""
    path = path or TOKENIZER
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoding(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            sizes = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, sizes], names=[*kept, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)
    return df.mapInArrow(run, f"{fields}, `{out}` long")
