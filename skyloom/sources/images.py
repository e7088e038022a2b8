"""Cut-out images: gzipped FITS to square arrays of floats, and their normalisation."""

from __future__ import annotations

import gzip
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 63
_KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def image(data: bytes, size: int = SIZE) -> np.ndarray:
    """The first image of a FITS file as ``size`` x ``size`` floats; smaller ones are centred in zeros."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    header, at = {}, 0
    while True:
        card = data[at : at + 80].decode("ascii")
        if len(card) < 80:
            raise ValueError("no end of the header")
        at += 80
        if card.startswith("END"):
            break
        if card[8:10] == "= ":
            header[card[:8].strip()] = card[10:].split("/")[0].strip()
    at = -(-at // 2880) * 2880
    width, height = int(header["NAXIS1"]), int(header["NAXIS2"])
    kind = np.dtype(_KINDS[int(header["BITPIX"])])
    pixels = np.frombuffer(data, kind, width * height, at).reshape(height, width).astype(np.float32)
    if "BSCALE" in header or "BZERO" in header:
        pixels = pixels * np.float32(header.get("BSCALE", 1)) + np.float32(header.get("BZERO", 0))
    if width > size or height > size:
        raise ValueError(f"an image of {width} x {height} is larger than {size}")
    out = np.zeros((size, size), np.float32)
    top, left = -(-(size - height) // 2), -(-(size - width) // 2)
    out[top : top + height, left : left + width] = pixels
    return out


def blank(size: int = SIZE) -> bytes:
    """A FITS image without light, gzipped."""
    cards = [f"{k:<8}= {v:>20}" for k, v in (("SIMPLE", "T"), ("BITPIX", -32), ("NAXIS", 2), ("NAXIS1", size), ("NAXIS2", size))]
    return gzip.compress("".join(c.ljust(80) for c in [*cards, "END"]).ljust(2880).encode() + np.zeros((size, size), ">f4").tobytes(), mtime=0)


def normalised(x: np.ndarray) -> np.ndarray:
    """NaN as zero, divided by the Frobenius norm if there is one."""
    x = np.nan_to_num(x, nan=0.0)
    n = np.linalg.norm(x)
    return x / n if n > 0 else x


@F.pandas_udf(T.ArrayType(T.FloatType()))
def pixels(data: pd.Series) -> pd.Series:
    """The normalised image, row by row; null for what is no image."""

    def one(b):
        try:
            return normalised(image(bytes(b))).ravel() if b is not None else None
        except (ValueError, KeyError, OSError, EOFError, UnicodeDecodeError):
            return None

    return data.map(one)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; within a lambda it would be computed again for each pixel."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cleaned(values: Column) -> Column:
    """Pixels with the middle one of the usable pixels in place of those that are no number or beyond 1e20."""
    usable = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) <= 1e20), F.lit(False))
    middle = lambda kept: F.get(kept, F.floor(F.size(kept) / 2).cast("int"))
    return _with(_with(F.array_sort(F.filter(values, usable)), middle), lambda m: F.transform(values, lambda v: F.when(usable(v), v).otherwise(m)))


def stretched(values: Column, how: str = "asinh") -> Column:
    """Pixels between 0 and 1, stretched for display."""
    shape = {"linear": lambda v: v, "sqrt": F.sqrt, "log": lambda v: F.log10(1 + 9 * v), "asinh": lambda v: F.asinh(10 * v) / F.asinh(F.lit(10.0))}[how]
    ends = F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high"))
    return _with(ends, lambda e: F.transform(values, lambda v: shape(F.coalesce(F.try_divide(v - e["low"], e["high"] - e["low"]), F.lit(0.0)))))


def limits(values: Column, low: float = 0.01, high: float = 1.0) -> Column:
    """struct<low, high>: the pixels at two ranks of an image in order, rank floor(share * pixels). A share of 0 or less
    takes 0 for the lower limit and one of 1 or more takes 1 for the upper one. Null for an image without pixels.

    Both are picked by selection, which is linear in the pixels; no image is put in order.
    """
    return _picked(values, F.lit(float(low)), F.lit(float(high)))


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _picked(values: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
    def one(v, a, b):
        if v is None or not len(v):
            return None, None
        x = np.asarray(v, np.float64)
        ranks = [int(np.floor(q * len(x))) for q in (a, b) if 0 < q < 1]
        x = np.partition(x, ranks) if ranks else x
        return (float(x[int(np.floor(a * len(x)))]) if a > 0 else 0.0), (float(x[int(np.floor(b * len(x)))]) if b < 1 else 1.0)

    return pd.DataFrame([one(*r) for r in zip(values, low, high)], columns=["low", "high"])


def clipped(values: Column, low: float = 0.01, high: float = 1.0) -> Column:
    """Pixels between two ranks of the image as 0 to 1, those beyond at the ends; one half where the limits are equal."""
    def scaled(e: Column) -> Column:
        width = e["high"] - e["low"]
        return F.transform(values, lambda v: F.when(width == 0, F.lit(0.5)).otherwise((F.greatest(e["low"], F.least(e["high"], v.cast("double"))) - e["low"]) / width))

    return _with(limits(values, low, high), scaled)
