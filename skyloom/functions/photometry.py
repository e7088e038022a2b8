"""Fluxes, magnitudes, times and the survey-specific normalisation of detections.

Photometry is single precision: results are cast to float after each step that stores one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: AB zero point, the signal-to-noise that makes a detection, and zero points of two surveys.
ZP_AB, SNT, ZTF_ZP, LSST_ZP_NJY = 8.90, 3.0, 23.9, 31.4
#: Filter ids and names.
ZTF_BANDS = {1: "g", 2: "r", 3: "i"}
WINTER_BANDS = {1: "j", 2: "h", 3: "k"}
#: First day (MJD, UTC) of each TAI - UTC in seconds.
LEAP_SECONDS = ((41317, 10), (41499, 11), (41683, 12), (42048, 13), (42413, 14), (42778, 15), (43144, 16), (43509, 17), (43874, 18), (44239, 19), (44786, 20), (45151, 21), (45516, 22), (46247, 23), (47161, 24), (47892, 25), (48257, 26), (48804, 27), (49169, 28), (49534, 29), (50083, 30), (50630, 31), (51179, 32), (53736, 33), (54832, 34), (56109, 35), (57204, 36), (57754, 37))
_POGSON = 2.5 / math.log(10)


def _inf() -> Column:
    return F.lit(float("inf"))


def flux_to_mag(flux: Column, err: Column, zp: Column | float) -> Column:
    """struct<mag, err>; no flux is infinitely faint, and a negative one has no magnitude."""
    f, e = flux.cast("double"), err.cast("double")
    mag = F.when(f == 0, _inf()).otherwise(-2.5 * F.log10(f) + zp)
    return F.struct(mag.cast("float").alias("mag"), F.when(f == 0, _inf()).otherwise(F.lit(_POGSON) * F.try_divide(e, f)).cast("float").alias("err"))


def flux_err_to_limit(err: Column, zp: Column | float) -> Column:
    return (-2.5 * F.log10(5.0 * err.cast("double")) + zp).cast("float")


def mag_to_flux(mag: Column, err: Column, zp: Column | float) -> Column:
    flux = F.power(F.lit(10.0), -0.4 * (mag.cast("double") - zp))
    return F.struct(flux.cast("float").alias("flux"), (err.cast("double") / 1.0857362 * flux).cast("float").alias("err"))


def limit_to_flux_err(limit: Column, zp: Column | float) -> Column:
    return (F.power(F.lit(10.0), (limit.cast("double") - zp) / -2.5) / 5.0).cast("float")


def mjd_to_jd(mjd: Column) -> Column:
    return mjd + 2400000.5


def tai_mjd_to_jd(mjd: Column) -> Column:
    """UTC Julian date of a TAI modified Julian date."""
    seconds = F.lit(10)
    for day, s in LEAP_SECONDS:
        seconds = F.when(mjd >= day + s / 86400.0, F.lit(s)).otherwise(seconds)
    return mjd_to_jd(mjd - seconds / 86400.0)


def is_positive(x: Column) -> Column:
    """The direction of a subtraction, given as text, number or boolean."""
    return F.lower(x.cast("string")).isin("t", "true", "1", "1.0")


def missing_to_null(x: Column, *sentinels: float) -> Column:
    """NaN and sentinels become null."""
    bad = F.isnan(x.cast("double"))
    for s in sentinels or (-99999.0,):
        bad = bad | (x == s)
    return F.when(~F.coalesce(bad, F.lit(True)), x)


def band_of(fid: Column, names: dict[int, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for k, name in names.items():
        out = F.when(fid == k, name).otherwise(out)
    return out


def ztf_candidate(c: Column) -> dict[str, Column]:
    """What a ZTF candidate gains: band, signed fluxes (nominal nJy at zero point 23.9), errors and signal-to-noise."""
    sign = F.when(is_positive(c["isdiffpos"]), 1.0).otherwise(-1.0)
    out = {"band": band_of(c["fid"], ZTF_BANDS), "isdiffpos": is_positive(c["isdiffpos"]), "ssnamenr": F.when(~c["ssnamenr"].isin("", "null"), c["ssnamenr"])}
    for kind, mag, err in (("psf", "magpsf", "sigmapsf"), ("ap", "magap", "sigmagap")):
        f = mag_to_flux(c[mag], c[err], ZTF_ZP)
        flux, sigma = f["flux"] * 1e9, f["err"] * 1e9
        out |= {f"{kind}Flux": (sign * flux).cast("float"), f"{kind}FluxErr": sigma.cast("float"), f"snr_{kind}": F.try_divide(flux, sigma).cast("float")}
    return out


def ztf_points(points: Column) -> Column:
    """Earlier ZTF points: detections get a signed flux and an unsigned signal-to-noise, limits a flux error; points with
    neither magnitude nor limit, or of an unknown filter, are left out."""

    def one(p: Column) -> Column:
        f = mag_to_flux(p["magpsf"], p["sigmapsf"], ZTF_ZP)
        sign = F.when(is_positive(p["isdiffpos"]), 1.0).otherwise(-1.0)
        seen = p["magpsf"].isNotNull() & p["sigmapsf"].isNotNull() & p["isdiffpos"].isNotNull()
        return F.struct(
            p["jd"].alias("jd"), band_of(p["fid"], ZTF_BANDS).alias("band"), p["programid"].alias("programid"), p["magpsf"].alias("magpsf"), p["sigmapsf"].alias("sigmapsf"), p["diffmaglim"].alias("diffmaglim"),
            F.when(seen, (sign * f["flux"] * 1e9).cast("float")).alias("psfFlux"), F.when(seen, f["err"] * 1e9).otherwise(limit_to_flux_err(p["diffmaglim"], ZTF_ZP) * 1e9).cast("float").alias("psfFluxErr"),
            F.when(seen, F.try_divide(f["flux"], f["err"])).cast("float").alias("snr"), p["ra"].alias("ra"), p["dec"].alias("dec"),
        )

    return F.filter(F.transform(points, one), lambda p: p["band"].isNotNull() & (p["psfFlux"].isNotNull() | p["diffmaglim"].isNotNull()))


def ztf_own_point(c: Column) -> Column:
    """A candidate as a point of its object's light curve, with the score that earlier points lack; null without a
    magnitude, an error or a direction, as it would be no detection."""
    n = ztf_candidate(c)
    seen = c["magpsf"].isNotNull() & c["sigmapsf"].isNotNull() & c["isdiffpos"].isNotNull()
    same = ("jd", "programid", "candid", "magpsf", "sigmapsf", "diffmaglim", "ra", "dec", "drb")
    return F.when(seen, F.struct(*(c[k].alias(k) for k in same), n["band"].alias("band"), n["psfFlux"].alias("psfFlux"), n["psfFluxErr"].alias("psfFluxErr"), n["snr_psf"].alias("snr"), n["apFlux"].alias("apFlux"), n["apFluxErr"].alias("apFluxErr"), n["snr_ap"].alias("snr_ap")))


def ztf_forced(points: Column) -> Column:
    """ZTF forced photometry, scaled from its own zero point; a magnitude where signal-to-noise exceeds 3."""

    def one(p: Column) -> Column:
        flux, err, zp = (missing_to_null(p[k].cast("double")) for k in ("forcediffimflux", "forcediffimfluxunc", "magzpsci"))
        scale = 1e9 * F.power(F.lit(10.0), (F.lit(ZTF_ZP) - zp) / 2.5)
        snr = F.try_divide(flux, err)
        m = flux_to_mag(flux, err, zp)
        good = F.abs(snr) > SNT
        return F.struct(
            p["jd"].alias("jd"), band_of(p["fid"], ZTF_BANDS).alias("band"), p["programid"].alias("programid"), p["procstatus"].alias("procstatus"), F.when(good & (flux > 0), m["mag"]).alias("magpsf"), F.when(good & (flux > 0), m["err"]).alias("sigmapsf"),
            flux_err_to_limit(err, zp).alias("diffmaglim"), (flux * scale).cast("float").alias("psfFlux"), (err * scale).cast("float").alias("psfFluxErr"), snr.cast("float").alias("snr"),
        )

    return F.filter(F.transform(points, one), lambda p: p["band"].isNotNull() & p["psfFluxErr"].isNotNull())


def lsst_source(s: Column) -> Column:
    """An LSST source: UTC date, magnitudes of absolute fluxes, limit, and the direction of its flux."""
    psf, ap = (flux_to_mag(F.abs(s[f"{k}Flux"]), s[f"{k}FluxErr"], LSST_ZP_NJY) for k in ("psf", "ap"))
    return F.struct(
        tai_mjd_to_jd(s["midpointMjdTai"]).alias("jd"), s["band"].alias("band"), s["ra"].alias("ra"), s["dec"].alias("dec"), psf["mag"].alias("magpsf"), psf["err"].alias("sigmapsf"), ap["mag"].alias("magap"), ap["err"].alias("sigmagap"),
        flux_err_to_limit(s["psfFluxErr"], LSST_ZP_NJY).alias("diffmaglim"), (s["psfFlux"] > 0).alias("isdiffpos"), s["psfFlux"].alias("psfFlux"), s["psfFluxErr"].alias("psfFluxErr"),
        F.try_divide(F.abs(s["psfFlux"]), s["psfFluxErr"]).cast("float").alias("snr"), (s["psfChi2"] / s["psfNdata"]).cast("float").alias("chipsf"),
    )


def lsst_forced(points: Column) -> Column:
    """LSST forced photometry: UTC date, limit, and above signal-to-noise 3 the magnitude of the absolute flux and its
    direction; without a flux there is only the limit, and points without an error are left out."""

    def one(p: Column) -> Column:
        snr = F.try_divide(F.abs(p["psfFlux"].cast("double")), p["psfFluxErr"].cast("double")).cast("float")
        m = flux_to_mag(F.abs(p["psfFlux"]), p["psfFluxErr"], LSST_ZP_NJY)
        seen = F.coalesce(snr > SNT, F.lit(False))
        return F.struct(
            tai_mjd_to_jd(p["midpointMjdTai"]).alias("jd"), p["band"].alias("band"), F.when(seen, m["mag"]).alias("magpsf"), F.when(seen, m["err"]).alias("sigmapsf"), flux_err_to_limit(p["psfFluxErr"], LSST_ZP_NJY).alias("diffmaglim"),
            F.when(seen, p["psfFlux"] > 0).alias("isdiffpos"), F.when(seen, snr).alias("snr"), p["psfFlux"].alias("psfFlux"), p["psfFluxErr"].alias("psfFluxErr"),
        )

    return F.transform(F.filter(points, lambda p: p["psfFluxErr"].isNotNull()), one)


def lsst_object_id(dia: Column, sso: Column) -> Column:
    """The id as text, or "sso" and the solar-system id; zero counts as missing."""
    return F.coalesce(F.when(dia != 0, dia.cast("string")), F.concat(F.lit("sso"), F.when(sso != 0, sso).cast("string")))


def lsst_history(dia_object: Column, jd: Column) -> dict[str, Column]:
    """First detection and number of detections of an object; a source without an object is its own first."""
    return {"jdstarthist": F.coalesce(tai_mjd_to_jd(dia_object["firstDiaSourceMjdTai"]), jd), "ndethist": F.coalesce(dia_object["nDiaSources"], F.lit(1)).cast("int")}


def decam_candidate(c: Column) -> dict[str, Column]:
    return {"jd": mjd_to_jd(c["mjd"]), "snr": F.try_divide(F.abs(c["forcediffimflux"]), c["forcediffimfluxunc"]).cast("float"), "flux_njy": c["forcediffimflux"] * 1000.0, "flux_err_njy": c["forcediffimfluxunc"] * 1000.0}


def winter_candidate(c: Column) -> dict[str, Column]:
    f = mag_to_flux(c["magpsf"], c["sigmapsf"], LSST_ZP_NJY)
    return {"band": band_of(c["fid"], WINTER_BANDS, "y"), "flux_njy": f["flux"], "flux_err_njy": f["err"], "jd": c["jd"]}
