"""Streams: each micro-batch of alerts is deduplicated, merged into its objects, matched and filtered.

Objects live in keyed state: one writer a key, so no locks or versions are needed for safety, and late points are merged
at any age. The version is kept because readers use it to see that an object has changed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A light curve as it is kept: its columns as packed numbers, sorted by time, and the names of its bands.
CURVE = "jd binary, mag binary, mag_err binary, band binary, bands array<string>, version int, designation string"
OBJECT = "objectId string, added long, points long, resorted boolean, first_jd double, last_jd double, version int, is_new boolean, designation string"


def deduplicated(alerts: DataFrame, key: str = "candid", event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """Each alert once. With an event time, keys are forgotten after ``delay``."""
    return alerts.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]) if event_time else alerts.dropDuplicates([key])


#: Groups that objects are dealt to. One call of Python takes a group's rows of a batch, since a call for each object
#: costs more than its points do. A checkpoint depends on this number.
GROUPS = 1024
_CODE = np.dtype("int32")


def merged(jd: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where points go in a light curve of sorted times: the places of new points that are taken, by time, and where in
    the stored ones each is put; and whether one of them precedes what was stored. The first point of each time is kept
    and non-finite times are left out."""
    at = np.flatnonzero(np.isfinite(new))
    times, first = np.unique(new[at], return_index=True)
    before = np.searchsorted(jd, times)
    known = jd[np.minimum(before, len(jd) - 1)] == times if len(jd) else np.zeros(len(times), bool)
    return at[first[~known]], before[~known], bool(len(jd) and (times[~known] < jd[-1]).any())


class Curves(StatefulProcessor):
    """Light curves of a group's objects, each a value of its own: a batch reads and writes those that it touches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.curves = handle.getMapState("curves", "object string", CURVE)

    def update(self, name: str | None, new: dict[str, np.ndarray]) -> tuple:
        """Merge an object's rows of a batch; its row of the result."""
        key = ("" if name is None else f"={name}",)
        old = self.curves.getValue(key)
        *packed, codes, bands, version, designation = old if old is not None else (b"", b"", b"", b"", [], 0, None)
        columns, codes, bands = [np.frombuffer(bytes(c)) for c in packed], np.frombuffer(bytes(codes), _CODE), list(bands)
        take, before, resort = merged(columns[0], new["jd"])
        known = designation
        if known is None:  # a designation, once known, stays
            known = next((x for x in new["designation"] if x), None)
        if len(take):
            place = {b: i for i, b in enumerate(bands)}
            code = [place.setdefault(b, len(place)) for b in new["band"][take]]
            columns = [np.insert(c, before, new[k][take]) for k, c in zip(("jd", "mag", "mag_err"), columns)]
            codes, bands = np.insert(codes, before, code), list(place)
        version += bool(len(take) or old is None)
        if len(take) or old is None or known != designation:
            self.curves.updateValue(key, (*(c.tobytes() for c in columns), codes.astype(_CODE).tobytes(), bands, version, known))
        jd = columns[0]
        return name, len(take), len(jd), resort, float(jd[0]) if len(jd) else None, float(jd[-1]) if len(jd) else None, version, old is None, known

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, parts = [], []
        for f in rows:
            names.append(f["objectId"].to_numpy(object))
            parts.append([*(f[k].to_numpy(float) for k in ("jd", "mag", "mag_err")), *(f[k].to_numpy(object) for k in ("band", "designation"))])
        found = np.concatenate(names)
        new = dict(zip(("jd", "mag", "mag_err", "band", "designation"), map(np.concatenate, zip(*parts))))
        code, objects = pd.factorize(found, use_na_sentinel=False)
        order = np.argsort(code, kind="stable")
        told = [self.update(None if pd.isna(o) else o, {k: c[at] for k, c in new.items()}) for o, at in zip(objects, np.split(order, np.bincount(code).cumsum()[:-1]))]
        yield pd.DataFrame(told, columns=[c.split()[0] for c in OBJECT.split(", ")])

    def close(self) -> None:
        pass


def objects_of(points: DataFrame) -> DataFrame:
    """A row for each object that a batch touches, from a stream (objectId, jd, mag, mag_err, band, designation).

    States are kept on the executors' disks, with their changes in the checkpoint.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's own worker may not find this module
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    dealt = points.select(F.pmod(F.xxhash64("objectId"), F.lit(GROUPS)).cast("int").alias("__group"), "objectId", "jd", "mag", "mag_err", "band", "designation")
    return dealt.groupBy("__group").transformWithStateInPandas(Curves(), OBJECT, "update", "none")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Start a query that hands every micro-batch to ``each``; with ``once`` it takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def standing_filters(alerts: DataFrame, load: Callable[[], list], tables: Callable[[], dict[str, DataFrame]], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run stored filters over every micro-batch. Filters and tables are looked up anew for each one, so changes take
    effect with the next batch; the batch is read once however many filters there are."""
    from skyloom.plans.filters import run_filters

    def each(batch: DataFrame, i: int) -> None:
        batch = batch.dropDuplicates(["_id"]).persist()
        try:
            sink(run_filters(batch, load(), tables()), i)
        finally:
            batch.unpersist()

    return run_batches(alerts, each, checkpoint, once)


def enrich_batches(alerts: DataFrame, enrich: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Enrich every micro-batch with a batch function, the same as for stored tables."""
    return run_batches(alerts, lambda b, i: sink(enrich(b), i), checkpoint, once)


def nightly(alerts: DataFrame, noon_offset_hours: float, delay: str = "2 days") -> DataFrame:
    """Counts by observing night of a stream with an event time ``ts``: a day's window that begins at local noon."""
    w = F.window("ts", "1 day", "1 day", f"{int(noon_offset_hours * 3600)} seconds")
    return alerts.withWatermark("ts", delay).groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").alias("noon"), "n")
