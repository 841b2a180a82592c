"""Series hash: 64-bit xxHash over the sorted labels, as 8 big-endian bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def stable_hash(labels: list[tuple[str, str]]) -> bytes:
    """Each name and each value is followed by the byte 0xFF; seed 0."""
    import xxhash

    data = b"".join(part.encode() + b"\xff" for pair in sorted(labels) for part in pair)
    return xxhash.xxh64_intdigest(data, seed=0).to_bytes(8, "big")


@F.pandas_udf(BinaryType())
def series_hash(labels: pd.Series) -> pd.Series:
    return labels.map(lambda row: stable_hash([(p["name"], p["value"]) for p in row]))
