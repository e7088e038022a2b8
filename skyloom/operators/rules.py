"""Classification rules, publishing gates and routing: boolean and text columns, no joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUBLIC = 1
#: The gates of the public streams.
LEAST_DRB, LEAST_RELIABILITY = 0.2, 0.0
#: Names of the public topics, by survey.
TOPICS = {
    "ZTF": tuple(f"ztf.{m}lsst-match.{c}" for m in ("", "no-") for c in ("stellar", "hosted", "hostless")),
    "LSST": tuple(f"lsst.{m}ztf-match.{c}" for m in ("", "no-") for c in ("stellar", "hosted", "hostless", "unknown")),
}


def _f(value: float) -> Column:
    return F.lit(float(value)).cast("float")


def _or(x: Column, value: float) -> Column:
    """Single precision, as the scores are stored: 0.49 isn't above 0.49."""
    return F.coalesce(x.cast("float"), _f(value))


def ztf_flags(c: Callable[[str], Column]) -> dict[str, Column]:
    """rock, star and near_brightstar of a ZTF candidate; a missing score counts as 0, a missing distance or magnitude
    as infinite. ``c`` gives a field of the candidate."""
    inf = float("inf")
    dist, score, r, z, i, g = (_or(c("distpsnr1"), inf), _or(c("sgscore1"), 0), *(_or(c(k), inf) for k in ("srmag1", "szmag1", "simag1", "sgmag1")))
    rock = (_or(c("ssdistnr"), inf) >= 0) & (_or(c("ssdistnr"), inf) < 12.0) & (_or(c("ssmagnr"), inf) >= 0)
    redder = lambda m: (m > 0) & (m < inf) & (r - m > 3.0)
    # fixed values: the thresholds of this function
    star = (dist >= 0) & (((score > _f(0.76)) & (dist <= 2.0)) | ((score > _f(0.2)) & (dist <= 1.0) & (r > 0) & (redder(z) | redder(i))))
    bright = (_or(c("neargaiabright"), inf) >= 0) & (_or(c("neargaiabright"), inf) <= 20.0) & (_or(c("maggaiabright"), inf) > 0) & (_or(c("maggaiabright"), inf) <= 12.0)
    for k in (1, 2, 3):
        m = _or(c(f"srmag{k}"), inf)
        bright = bright | ((_or(c(f"sgscore{k}"), 0) > _f(0.49)) & (_or(c(f"distpsnr{k}"), inf) <= 20.0) & (m > 0) & (m <= 15.0))
    bright = bright | ((score == 0.5) & (dist < 0.5) & ((g < 17.0) | (r < 17.0) | (i < 17.0)))
    return {"rock": rock, "star": star, "near_brightstar": bright}


def sso(c: Callable[[str], Column]) -> Column:
    """The solar-system association: negative distances and magnitudes are missing."""
    d, m = (F.when(c(k) >= 0, c(k)) for k in ("ssdistnr", "ssmagnr"))
    name = F.when(~c("ssnamenr").isin("", "null"), c("ssnamenr"))
    return F.struct(name.isNotNull().alias("is_sso"), name.alias("designation"), d.alias("distance"), m.alias("magnitude"))


def lsst_flags(neighbours: Column, in_footprint: Column, sso_id: Column) -> dict[str, Column]:
    """Flags of an LSST source from its star-galaxy neighbours (distance_arcsec, score, mag_white): unknown, and so
    null, without neighbours outside the footprint."""
    known = F.coalesce(F.size(neighbours) > 0, F.lit(False)) | in_footprint
    star = F.exists(neighbours, lambda n: (n["distance_arcsec"] <= 1.0) & (n["score"] > 0.5))
    bright = F.exists(neighbours, lambda n: (n["distance_arcsec"] <= 20.0) & (n["score"] > 0.5) & (n["mag_white"] <= 15.0))
    return {"rock": sso_id.isNotNull() & (sso_id != 0), "star": F.when(known, F.coalesce(star, F.lit(False))), "near_brightstar": F.when(known, F.coalesce(bright, F.lit(False)))}


def ztf_category(star: Column, bright: Column, scores: list[Column], has_lsst: Column) -> Column:
    """The public topic: stellar, else hosted if any score lies in [0, 0.5], else hostless."""
    hosted = F.lit(False)
    for s in scores:
        hosted = hosted | F.coalesce(s.between(0.0, 0.5), F.lit(False))
    kind = F.when(F.coalesce(star | bright, star, bright, F.lit(False)), "stellar").when(hosted, "hosted").otherwise("hostless")
    return F.concat(F.lit("ztf."), F.when(has_lsst, "lsst-match.").otherwise("no-lsst-match."), kind)


def lsst_category(star: Column, bright: Column, neighbours: Column, in_footprint: Column, has_ztf: Column) -> Column:
    """The public topic: stellar; without neighbours hostless or, outside the footprint, unknown; hosted if any score is
    at most 0.5; else hostless."""
    none = F.coalesce(F.size(neighbours) <= 0, F.lit(True))
    hosted = F.coalesce(F.exists(neighbours, lambda n: n["score"] <= 0.5), F.lit(False))
    stellar = F.coalesce(star, F.lit(False)) | F.coalesce(bright, F.lit(False))
    kind = F.when(stellar, "stellar").when(none & in_footprint, "hostless").when(none, "unknown").when(hosted, "hosted").otherwise("hostless")
    return F.concat(F.lit("lsst."), F.when(has_ztf, "ztf-match.").otherwise("no-ztf-match."), kind)


def ztf_public(programid: Column, rock: Column, drb: Column) -> Column:
    return (programid == PUBLIC) & ~F.coalesce(rock, F.lit(False)) & (_or(drb, 0) >= _f(LEAST_DRB))


def lsst_public(reliability: Column, pixel_flags: Column, rock: Column) -> Column:
    return (_or(reliability, 0) >= _f(LEAST_RELIABILITY)) & ~F.coalesce(pixel_flags, F.lit(False)) & ~F.coalesce(rock, F.lit(False))


def public_points(points: Column) -> Column:
    """Points of the public programme that have a flux and a position."""
    return F.filter(points, lambda p: F.coalesce((p["programid"] == PUBLIC) & p["psfFlux"].isNotNull() & p["ra"].isNotNull() & p["dec"].isNotNull(), F.lit(False)))


def permitted(points: Column, programs: list[int]) -> Column:
    """Points whose programme is among those allowed."""
    return F.filter(points, lambda p: F.coalesce(p["programid"].isin(programs), F.lit(False)) if programs else F.lit(False))


def classifications(scores: dict[str, Column]) -> Column:
    """array<struct<classifier, score>> of the scores that there are."""
    kind = "array<struct<classifier:string,score:double>>"
    return F.filter(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("classifier"), v.cast("double").alias("score"))) for k, v in scores.items())).cast(kind), lambda x: x.isNotNull())


#: The scores that a survey's packets carry, in order; a score of shape comes with a distance.
PACKET_SCORES = {"ZTF": ("rb", "drb", "sgscore1"), "LSST": ("reliability",), "DECAM": ("reliability",), "WINTER": ("rb", "sgscore1")}
MODEL_SCORES = ("acai_h", "acai_n", "acai_o", "acai_v", "acai_b", "btsbot")


def survey_classifications(survey: str, candidate: Callable[[str], Column], scored: Callable[[str], Column] | None = None) -> Column:
    """array<struct<classifier, score, distance_arcsec>> of a survey's packets: the candidate's own scores that there are,
    a star's only with its distance, and behind them those of the models if the alert was scored."""
    kind = "array<struct<classifier:string,score:float,distance_arcsec:float>>"

    def one(name: str, score: Column, distance: Column | None = None) -> Column:
        there = score.isNotNull() if distance is None else score.isNotNull() & distance.isNotNull()
        return F.when(there, F.struct(F.lit(name).alias("classifier"), score.cast("float").alias("score"), (F.lit(None) if distance is None else distance).cast("float").alias("distance_arcsec")))

    own = [one(n, candidate(n), candidate("distpsnr1") if n == "sgscore1" else None) for n in PACKET_SCORES[survey]]
    more = [one(n, scored(n)) for n in MODEL_SCORES] if scored and survey == "ZTF" else []
    return F.filter(F.array(*own, *more).cast(kind), lambda x: x.isNotNull())


def packet_photometry(survey: str, *series: Column) -> Column:
    """Series of points as those of an output packet: time order, band with the survey's name, origin."""
    own = [F.transform(s, lambda p: F.struct(p["jd"].alias("jd"), p["psfFlux"].cast("double").alias("flux"), p["psfFluxErr"].cast("double").alias("flux_err"), F.concat(F.lit(survey.lower()), p["band"]).alias("band"), F.lit(survey).alias("survey"), p["programid"].alias("programid"))) for s in series]
    return F.array_sort(F.concat(*own), lambda a, b: F.when(a["jd"] < b["jd"], -1).when(a["jd"] > b["jd"], 1).otherwise(0))


def by_topic(packets: DataFrame, topic: str = "topic") -> DataFrame:
    return packets.where(F.col(topic).isNotNull()).groupBy(topic).agg(F.count("*").alias("packets"))
