"""The compressibility probe as a column function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from coffer.sources.archives import worthwhile


@pandas_udf(T.BooleanType())
def is_worthwhile(content: pd.Series) -> pd.Series:
    """Whether the first 256 KiB deflate below 0.97 of their size; false for empty, true for null (as for an unreadable file)."""
    return content.map(lambda b: True if b is None else worthwhile(bytes(b)))
