"""Stored tables that are laid out for the searches made in them, and tables that are replaced as one step.

A table by sky is partitioned by coarse cells and in order of fine ones, so that a cone reads the files of its cells; a
table by key is partitioned by a hash of the key, so that an id reads the files of its bucket. The partition column's
name tells the depth or the number of buckets, so a reader needs nothing but the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions import sky
from skyloom.operators import coverage

#: Depth of the fine cells that rows are put in order by.
FINE = 11
FINE_COLUMN = "sky_pixel"
#: The most points that one search may name.
MOST_POINTS = 1000
#: Beyond so many ranges a search prunes by cells alone; a condition of thousands of comparisons costs more than it saves.
MOST_RANGES = 200
_BY_SKY, _BY_KEY = re.compile(r"sky_cell_at_(\d+)"), re.compile(r"key_bucket_of_(\d+)")


def is_layout(column: str) -> bool:
    return column == FINE_COLUMN or bool(_BY_SKY.fullmatch(column) or _BY_KEY.fullmatch(column))


# ---- by sky ----


def write_by_sky(df: DataFrame, folder: str, ra: str = "ra", dec: str = "dec", depth: int = 3, files: int | None = None, mode: str = "errorifexists", also: tuple[str, ...] = ()) -> None:
    """Writes rows by cell. They are dealt out by ranges of fine cells, and by a hash within one, so a crowded cell is
    several files of several tasks. Rows without a position lie in a partition of their own. ``also`` names fields that
    hold the same position, such as GeoJSON points; the table remembers them and its own."""
    name, known = f"sky_cell_at_{depth}", {"positions": [ra, *also]}
    placed = df.withColumn(FINE_COLUMN, coverage.pixel(F.col(ra), F.col(dec), FINE).alias(FINE_COLUMN, metadata=known))
    spread = placed.withColumn(name, F.shiftright(FINE_COLUMN, 2 * (FINE - depth))).withColumn("__salt", F.xxhash64(F.col(ra), F.col(dec), F.monotonically_increasing_id()))
    dealt = spread.repartitionByRange(*([files] if files else []), FINE_COLUMN, "__salt")
    dealt.drop("__salt").sortWithinPartitions(name, FINE_COLUMN).write.mode(mode).partitionBy(name).parquet(folder)


def in_cones(schema: T.StructType, position: str, cones: Iterable[tuple[float, float, float]]) -> Column | None:
    """A condition on the layout's columns that holds wherever ``position`` lies in one of the cones (ra, dec, degrees);
    None for a table that isn't laid out by that position. Cells prune partitions, ranges of fine cells row groups."""
    held = next((m for m in map(_BY_SKY.fullmatch, schema.names) if m), None)
    if not held or FINE_COLUMN not in schema.names or position not in schema[FINE_COLUMN].metadata.get("positions", ()):
        return None
    found = sorted({r for c in cones for r in coverage.cone(*c, FINE)})
    down = 2 * (FINE - int(held[1]))
    cells = sorted({n for low, high in found for n in range(low >> down, ((high - 1) >> down) + 1)})
    tests = [(F.col(FINE_COLUMN) >= low) & (F.col(FINE_COLUMN) < high) for low, high in found]
    fine = reduce(lambda a, b: a | b, tests, F.lit(False)) if len(tests) <= MOST_RANGES else F.lit(True)
    return F.col(held.string).isin(cells) & fine


def cone(df: DataFrame, ra: float, dec: float, arcsec: float, at: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """The rows within a cone, with ``distance_arcsec``; of a table by sky only the files of the cone's cells are read."""
    near = in_cones(df.schema, at[0], [(ra, dec, arcsec / 3600.0)])
    some = df if near is None else df.where(near)
    d = sky.separation_arcsec(F.col(at[0]), F.col(at[1]), F.lit(float(ra)), F.lit(float(dec)))
    return some.withColumn("distance_arcsec", d).where(F.col("distance_arcsec") <= arcsec)


def around(df: DataFrame, points: DataFrame, arcsec: float, at: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """What of a table has to be read for a search around points (ra, dec), of which there may be ``MOST_POINTS``."""
    if in_cones(df.schema, at[0], []) is None:
        return df
    asked = points.select(F.col("ra").cast("double"), F.col("dec").cast("double")).where("ra IS NOT NULL AND dec IS NOT NULL").limit(MOST_POINTS + 1).collect()
    if len(asked) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points")
    return df.where(in_cones(df.schema, at[0], [(r.ra, r.dec, arcsec / 3600.0) for r in asked]))


# ---- by key ----


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_by_key(df: DataFrame, folder: str, key: str, buckets: int = 256, mode: str = "errorifexists", files: int = 1) -> None:
    """Writes rows by a hash of their key, those of one bucket in up to ``files`` files and in order of the key. With more
    than one file a key's rows are spread over them, so a hot key is several tasks' work."""
    name = f"key_bucket_of_{buckets}"
    known = df.withMetadata(key, {"bucketed": True}).withColumn(name, bucket(F.col(key), buckets))
    dealt = known.repartition(name, *([F.pmod(F.xxhash64(*df.columns), F.lit(files))] if files > 1 else []))
    dealt.sortWithinPartitions(name, key).write.mode(mode).partitionBy(name).parquet(folder)


def _buckets(df: DataFrame, key: str) -> tuple[str, int] | None:
    held = next((m for m in map(_BY_KEY.fullmatch, df.columns) if m), None)
    return (held.string, int(held[1])) if held and df.schema[key].metadata.get("bucketed") else None


def with_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; of a table by that key only the files of its bucket are read."""
    rows, layout = df.where(F.col(key) == F.lit(value)), _buckets(df, key)
    return rows.where(F.col(layout[0]) == bucket(F.lit(value).cast(df.schema[key].dataType), layout[1])) if layout else rows


def buckets_of(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """What of a table has to be read for ``keys``: the buckets that they lie in, of which there are no more than the
    layout has."""
    layout = _buckets(df, key)
    if not layout:
        return df
    at = bucket(F.col(key).cast(df.schema[key].dataType), layout[1])
    return df.where(F.col(layout[0]).isin([r[0] for r in keys.select(at).distinct().collect()]))


# ---- replaced as one step ----


class Invalid(ValueError):
    """A new version that must not be published, and why."""


class Versions:
    """A table in versions. A reader gets the last one that was published, whole, whatever is being written beside it.

    A run writes under its name, has the rows checked, and publishes: one small record, which counts only once it is
    complete. A run that was stopped anywhere goes on where it was when it is started again with the same name; what it
    has published is not done again. One run at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _complete(self, pattern: str) -> list[str]:
        """Paths of finished writes."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}/_SUCCESS")
        found = path.getFileSystem(conf).globStatus(path) or []
        return [f.getPath().getParent().toString() for f in found]

    def published(self) -> dict[int, str]:
        """The runs that made each version."""
        records = self._complete("published/version=*")
        if not records:
            return {}
        rows = self.spark.read.schema("version long, run string").json(records).collect()
        return {r.version: r.run for r in rows}

    def read(self) -> DataFrame:
        versions = self.published()
        if not versions:
            raise ValueError(f"nothing is published in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/runs/{versions[max(versions)]}")

    def replace(self, run: str, make: Callable[[DataFrame | None], DataFrame], check: Callable[[DataFrame | None, DataFrame], None] | None = None) -> int:
        """Writes, checks and publishes what ``make`` makes of the last version (None for the first); its number."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
            raise ValueError(f"{run!r} is no name of a run")
        versions = self.published()
        if run in versions.values():
            return next(n for n, r in versions.items() if r == run)
        before = self.read() if versions else None
        base, path = max(versions, default=0), f"{self.folder}/runs/{run}"
        if not self._complete(f"runs/{run}") or self._base(run) != base:
            self._note(run, base)
            make(before).write.mode("overwrite").parquet(path)
        if check:
            check(before, self.spark.read.parquet(path))
        record = self.spark.createDataFrame([(base + 1, run)], "version long, run string").coalesce(1)
        record.write.mode("overwrite").json(f"{self.folder}/published/version={base + 1}")
        return base + 1

    def _note(self, run: str, base: int) -> None:
        self.spark.createDataFrame([(base,)], "base long").coalesce(1).write.mode("overwrite").json(f"{self.folder}/bases/{run}")

    def _base(self, run: str) -> int:
        return self.spark.read.schema("base long").json(f"{self.folder}/bases/{run}").first().base


def same_but(column: str, key: str) -> Callable[[DataFrame | None, DataFrame], None]:
    """A check that every key is there once, and that all but one column is as it was."""

    def digest(df: DataFrame) -> tuple:
        rest = [c for c in sorted(df.columns) if c != column]
        text = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.sum(F.hash(text).cast("long"))).first())

    def check(before: DataFrame | None, after: DataFrame) -> None:
        twice = after.groupBy(key).count().where("count > 1").limit(1).count()
        if twice:
            raise Invalid(f"a {key} stands more than once")
        if before is not None and digest(before) != digest(after):
            raise Invalid(f"more than {column} has changed")

    return check
