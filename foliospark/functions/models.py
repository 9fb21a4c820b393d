"""User models run over partitions, and raster functions on decoded images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOADED: dict[str, object] = {}


def score_partitions(df: DataFrame, load_model: Callable[[], object], predict: Callable[[object, pd.DataFrame], pd.Series], schema: str, name: str = "model") -> DataFrame:
    """Adds a column by the user's model, loaded once a worker. A batch that fails is scored row by row; rows that fail carry ``error``. Other columns pass, whatever their names and types."""
    added = T.StructType([*T.StructType.fromDDL(schema), T.StructField("error", T.StringType())])
    out, names = added.fieldNames()[0], df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.set_axis(names, axis=1) for b in batches):
            if name not in _LOADED:
                _LOADED[name] = load_model()
            model = _LOADED[name]
            try:
                yield batch.assign(**{out: predict(model, batch)}, error=None)
            except Exception:
                for i in range(len(batch)):
                    row = batch.iloc[[i]]
                    try:
                        yield row.assign(**{out: predict(model, row)}, error=None)
                    except Exception as e:
                        yield row.assign(**{out: None}, error=str(e))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (b.set_axis(places, axis=1) for b in run(batches))

    places = [f"c{i}" for i in range(len(names) + len(added))]  # names may be any
    plain = T.StructType([T.StructField(c, f.dataType) for c, f in zip(places, [*df.schema, *added], strict=True)])
    return df.toDF(*places[: len(names)]).mapInPandas(numbered, plain).toDF(*names, *added.fieldNames())


@F.pandas_udf(T.ArrayType(T.LongType()))
def raster_histogram(data: pd.Series) -> pd.Series:
    """256 counts of an image's bytes."""
    return pd.Series([None if d is None else np.bincount(np.frombuffer(d, dtype=np.uint8), minlength=256).tolist() for d in data])


def _otsu(counts: np.ndarray) -> int:
    """The smallest grey level with the largest variance between what is at most it and what is above; whole numbers until the last division."""
    levels = np.flatnonzero(counts)
    n, mass = np.cumsum(counts[levels]), np.cumsum(counts[levels] * levels)
    rest = n[-1] - n
    apart = (mass[-1] * n - n[-1] * mass).astype(np.float64) ** 2
    return int(levels[np.argmax(np.divide(apart, (n * rest).astype(np.float64), out=np.zeros(len(n)), where=rest > 0))])


def grey_levels(data: bytes, channels: int) -> np.ndarray:
    """An image's bytes as grey levels: of blue, green and red the usual weighted mean, of a fourth channel nothing."""
    pixels = np.frombuffer(data, dtype=np.uint8)
    if channels < 3:
        return pixels
    b, g, r = (pixels[i::channels].astype(np.int64) for i in range(3))
    return ((114 * b + 587 * g + 299 * r + 500) // 1000).astype(np.uint8)


_BINARISED = T.StructType([T.StructField("threshold", T.IntegerType()), T.StructField("ink", T.LongType()), T.StructField("paper", T.LongType())])


@F.pandas_udf(_BINARISED)
def image_threshold(data: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """From decoded bytes to the threshold, with pixels up to it (ink) and above (paper): one pass, no row a pixel. Null for an image without bytes."""
    found = []
    for d, c in zip(data, channels, strict=True):
        counts = np.bincount(grey_levels(d, int(c)), minlength=256) if d else None
        t = None if counts is None else _otsu(counts)
        found.append((None, None, None) if t is None else (t, int(counts[: t + 1].sum()), int(counts[t + 1 :].sum())))
    return pd.DataFrame(found, columns=_BINARISED.fieldNames(), dtype=object).astype({"threshold": "Int32", "ink": "Int64", "paper": "Int64"})
