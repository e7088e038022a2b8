"""Model scores for alerts, a batch at a time: a model is whatever scores feature rows and image triplets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.sources.images import SIZE, image, normalised

#: The order of the candidate's features in both kinds of models.
CANDIDATE_FEATURES = (
    "drb", "diffmaglim", "ra", "dec", "magpsf", "sigmapsf", "chipsf", "fwhm", "sky", "chinr", "sharpnr", "sgscore1", "distpsnr1",
    "sgscore2", "distpsnr2", "sgscore3", "distpsnr3", "ndethist", "ncovhist", "scorr", "nmtchps", "clrcoeff", "clrcounc", "neargaia", "neargaiabright",
)
CURVE_FEATURES = ("age", "days_since_peak", "days_to_peak", "peakmag_so_far", "maxmag_so_far", "nnondet")

#: The order of the features of the model that takes light curves too.
BOTH_FEATURES = (
    "sgscore1", "distpsnr1", "sgscore2", "distpsnr2", "fwhm", "magpsf", "sigmapsf", "chipsf", "ra", "dec", "diffmaglim", "ndethist", "nmtchps",
    "age", "days_since_peak", "days_to_peak", "peakmag_so_far", "drb", "ncovhist", "nnondet", "chinr", "sharpnr", "scorr", "sky", "maxmag_so_far",
)


#: Alerts that are decoded and scored at a time: their triplets take 12 MB in single precision.
SLICE = 256


class Model(Protocol):
    """Scores n rows of features (n, k) and triplets (n, SIZE, SIZE, 3); returns n scores."""

    def predict(self, features: np.ndarray, triplets: np.ndarray) -> np.ndarray: ...


class OnnxModel:
    """A model file, opened on first use in each worker."""

    def __init__(self, path: str, feature_input: str, image_input: str, output: str):
        self.path, self.inputs, self.output, self.session = path, (feature_input, image_input), output, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"session": None}

    def predict(self, features: np.ndarray, triplets: np.ndarray) -> np.ndarray:
        if self.session is None:
            import onnxruntime

            self.session = onnxruntime.InferenceSession(self.path)
        return self.session.run([self.output], dict(zip(self.inputs, (features.astype(np.float32), triplets.astype(np.float32)))))[0].ravel()


def curve_features(jd: Column, stats: Callable[[str], Column], non_detections: Column) -> dict[str, Column]:
    """Features that come from a light curve's statistics at the time of an alert."""
    return {
        "age": jd - stats("first_jd"), "days_since_peak": jd - stats("peak_jd"), "days_to_peak": stats("peak_jd") - stats("first_jd"),
        "peakmag_so_far": stats("peak_mag"), "maxmag_so_far": stats("faintest_mag"), "nnondet": non_detections,
    }


def both_features(alerts: DataFrame, stats: DataFrame, key: str = "_id") -> DataFrame:
    """(key, BOTH_FEATURES, cut-outs) of alerts with their light curves' statistics (key, figures over all bands) as of each
    alert. This model's age counts back from the first point to the last, so it is no more than 0. An alert without
    usable points has no such features, and so no score."""
    figures = {"age": "first_jd - last_jd", "days_since_peak": "last_jd - peak_jd", "days_to_peak": "peak_jd - first_jd", "peakmag_so_far": "peak_mag", "maxmag_so_far": "faintest_mag"}
    made = stats.select(F.col(key), *(F.expr(e).cast("float").alias(k) for k, e in figures.items()))
    own = [F.col(f"candidate.{f}").cast("float").alias(f) for f in BOTH_FEATURES if f not in CURVE_FEATURES]
    nnondet = (F.col("candidate.ncovhist") - F.col("candidate.ndethist")).cast("float").alias("nnondet")
    images = [c for c in ("cutoutScience", "cutoutTemplate", "cutoutDifference") if c in alerts.columns]
    return alerts.select(key, *own, nnondet, *images).join(made, key, "left").select(key, *BOTH_FEATURES, *images)


def scored(rows: DataFrame, models: dict[str, tuple[Model, tuple[str, ...]]], cutouts: tuple[str, str, str] = ("cutoutScience", "cutoutTemplate", "cutoutDifference"), key: str = "_id") -> DataFrame:
    """(key, classifications): a struct of scores for each alert.

    Every model has its features; an alert without all features of all models, or without three readable images, has
    null in place of the struct.
    """
    names = list(models)
    needed = list(dict.fromkeys(f for _, fs in models.values() for f in fs))
    kind = "struct<" + ", ".join(f"{n}: double" for n in names) + ">"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (whole.iloc[at : at + SLICE] for whole in frames for at in range(0, len(whole), SLICE)):
            values = frame[needed].to_numpy(float)
            usable, triplets = [], []
            decoded: dict[bytes, np.ndarray] = {}  # stand-ins for missing cut-outs are the same for many alerts

            def read(data: bytes) -> np.ndarray:
                if data not in decoded:
                    decoded[data] = normalised(image(data))
                return decoded[data]

            for i in np.flatnonzero(np.isfinite(values).all(1)):
                try:
                    triplets.append(np.stack([read(bytes(frame[c].iat[i])) for c in cutouts], -1))
                    usable.append(i)
                except (ValueError, KeyError, OSError, EOFError, TypeError):
                    continue
            out: list = [None] * len(frame)
            if usable:
                x, t = values[usable], np.stack(triplets).reshape(-1, SIZE, SIZE, 3)
                columns = [np.asarray(m.predict(x[:, [needed.index(f) for f in fs]], t), float) for m, fs in models.values()]
                for row, i in enumerate(usable):
                    out[i] = {n: float(c[row]) for n, c in zip(names, columns)}
            yield pd.DataFrame({key: frame[key].to_numpy(), "classifications": pd.Series(out, dtype=object)})

    picked = rows.select(key, *(F.col(f).cast("double").alias(f) for f in needed), *cutouts)
    return picked.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, classifications {kind}")
