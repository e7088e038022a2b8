"""Alerts through three stages in one stream: stored and matched, enriched, filtered.

What a batch needs of the past is in keyed state: the alerts that an object had, which are its history, and the position
of its first sight, from which its matches with the static catalogues are made again where a filter names them. So a
micro-batch reads its own rows, the static catalogues and the other surveys' tables, and none of what earlier batches
have written; its work doesn't grow with their number. It writes into folders of its own number, so a batch that is run
again after a failure replaces what it had written: the effect is that of running once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyloom.operators import crossmatch, enrich
from skyloom.plans import filters

from .state import run_batches

POINT = "struct<jd:double,candid:bigint,magpsf:double,sigmapsf:double,band:string,programid:int,snr:double>"
#: What the state keeps of each alert.
KEPT = {"ids": "bigint", "jd": "double", "magpsf": "double", "sigmapsf": "double", "band": "string", "programid": "double"}
#: The state of an object is one text, which is cheaper to pass to and fro than arrays: what is kept, column by column,
#: and where it was first seen.
STATE = "kept string"
OUT = "objectId string, alert string, is_new boolean, kept string"


def history_of(days: float | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state's update: it tells each alert that is new, and the object with its whole history and the position of its
    first sight if there is one. Of a batch the alert of least id is the first."""
    names = list(KEPT)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = json.loads(state.get[0]) if state.exists else None
        points = dict(zip(old["ids"], zip(*(old[k] for k in names)))) if old else {}
        new: dict[int, tuple] = {}
        texts: dict[int, str] = {}
        at: dict[int, dict] = {}
        clean = lambda x: None if x != x else x  # noqa: E731  # NaN stands for null in a frame
        for f in frames:
            for *point, ra, dec, alert in zip(*(f[k].tolist() for k in (*names, "ra", "dec", "alert"))):
                if point[0] not in points and point[0] not in new:
                    new[point[0]], texts[point[0]], at[point[0]] = tuple(map(clean, point)), alert, {"ra": clean(ra), "dec": clean(dec)}
        if not new:
            return
        first = old["first"] if old else at[min(new)]
        points |= new
        if days is not None:
            last = max((p[1] for p in points.values() if p[1] is not None), default=None)
            points = {i: p for i, p in points.items() if p[1] is None or p[1] > last - days}
        kept = json.dumps({k: [p[i] for p in points.values()] for i, k in enumerate(names)} | {"first": first})
        state.update((kept,))
        yield pd.DataFrame({"objectId": [key[0]] * (len(new) + 1), "alert": [*texts.values(), None], "is_new": [None] * len(new) + [not old], "kept": [None] * len(new) + [kept]})

    return update


@dataclass(frozen=True)
class Stages:
    """Where the stages keep their tables, and what they work with.

    ``catalogs`` are static tables that an object is matched with where it was first seen. Its matches are stored with
    it then, and made again in a batch whose filters name them, so the tables must stay as they are. ``others`` gives the
    tables of other surveys' objects (objectId, ra, dec) as they are now, in which every alert's nearest counterpart is
    looked up anew. With ``days``, points older than that before an object's newest one are forgotten; an alert that old would be
    new again.
    """

    folder: str
    catalogs: dict[str, DataFrame]
    configs: list[crossmatch.Catalog]
    others: Callable[[], dict[str, DataFrame]]
    load: Callable[[], list[filters.Filter]]
    survey: str = "ZTF"
    days: float | None = None

    def table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """What the batches have written."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/{name}").drop("batch")

    def write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def keyed(self, alerts: DataFrame) -> DataFrame:
        """The stream of new alerts and of the objects that they touch, from the stream of alerts."""
        c = {k: F.col(f"candidate.{k}").cast(t) for k, t in (KEPT | {"ra": "double", "dec": "double"}).items() if k != "ids"}
        own = alerts.select("objectId", F.col("_id").cast("bigint").alias("ids"), *(x.alias(k) for k, x in c.items()), F.to_json(F.struct(*alerts.columns)).alias("alert"))
        return own.groupBy("objectId").applyInPandasWithState(history_of(self.days), OUT, STATE, "append", GroupStateTimeout.NoTimeout)

    def _objects(self, rows: DataFrame) -> DataFrame:
        """Objects with their history by time and the position of their first sight, from what the state tells."""
        names = list(KEPT)
        point = lambda x: F.struct(x["jd"], x["ids"].alias("candid"), *(x[k] for k in names[2:]), (1.0857362 / x["sigmapsf"]).alias("snr")).cast(POINT)
        parsed = F.from_json("kept", ", ".join(f"{k} array<{t}>" for k, t in KEPT.items()) + ", first struct<ra:double,dec:double>")
        told = rows.select("objectId", "is_new", parsed.alias("k")).select("objectId", "is_new", "k.*")
        return told.select("objectId", "is_new", F.array_sort(F.transform(F.arrays_zip(*names), point)).alias("prv_candidates"), F.col("first").alias(filters.FIRST_SIGHT))

    def matched(self, objects: DataFrame) -> DataFrame:
        """Rows of objects, each once, with ``cross_matches`` of the position of their first sight."""
        if not self.configs:
            return objects
        rest = [c for c in objects.columns if c not in ("ra", "dec")]
        at = objects.select(*rest, F.struct("objectId").alias("__key"), *(F.col(f"{filters.FIRST_SIGHT}.{k}").alias(k) for k in ("ra", "dec")))  # unlike an id, a key is never null
        return crossmatch.crossmatch(at, self.catalogs, self.configs, "__key").drop("__key", "ra", "dec")

    def each(self, kind: T.StructType) -> Callable[[DataFrame, int], None]:
        """What is done with a batch of the keyed stream, for alerts of a schema."""

        def run(batch: DataFrame, i: int) -> None:
            batch = batch.persist()
            try:
                told = batch.where("alert IS NOT NULL").select(F.from_json("alert", kind).alias("a")).select("a.*")
                new = self.write(told, "alerts", i)
                objects = self._objects(batch.where("alert IS NULL"))
                self.write(self.matched(objects.where("is_new").drop("is_new", "prv_candidates")).drop(filters.FIRST_SIGHT), "objects", i)
                at = new.groupBy("objectId").agg(F.min_by(F.struct("candidate.ra", "candidate.dec"), "_id").alias("at")).select("objectId", "at.*")
                objects = crossmatch.aliases(objects.drop("is_new").join(at, "objectId"), self.survey, self.others())
                properties = enrich.ztf_properties(new, objects) if self.survey == "ZTF" else enrich.plain_properties(new, objects)
                enriched = self.write(new.join(properties, "_id"), "enriched", i)
                self.write(filters.run_filters(enriched, self.load(), {f"{self.survey}_objects": objects}, self.matched if self.configs else None), "results", i)
            finally:
                batch.unpersist()

        return run


def run(alerts: DataFrame, stages: Stages, checkpoint: str, once: bool = True):
    """Start the three stages over a stream of alerts (_id, objectId, candidate with ra and dec).

    States are kept on the executors' disks, with their changes in the checkpoint.
    """
    alerts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return run_batches(stages.keyed(alerts), stages.each(alerts.schema), checkpoint, once)
