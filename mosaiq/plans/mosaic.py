"""Photographs in, mosaics and reports out: the whole plan, for one folder or many stores at once."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException, PythonException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from mosaiq.functions.homography import implausible
from mosaiq.kernels import blend as B
from mosaiq.kernels.detect import KINDS
from mosaiq.operators import compose as C, pairing as P
from mosaiq.operators.graph import _kept
from mosaiq.operators.matching import edge_score, replaced, rescue_reason
from mosaiq.sources import images as S


#: What a job is lost by.
LOST = (PythonException, PySparkException, Py4JJavaError)


#: Names and defaults of all settings.
@dataclass
class Config:
    """Settings of a run; wrong names of methods are refused at once."""

    work_max_dim: int = 1600
    detector: str = "rootsift"
    n_features: int = 12000
    ratio: float = 0.85
    ransac_thresh: float = 3.0
    min_inliers: int = 40
    min_inlier_ratio: float = 0.10
    min_ncc: float = 0.25
    min_overlap: float = 0.04
    n_hypotheses: int = 6
    ecc_refine: bool = False
    plausibility_gate: bool = True
    use_deep_fallback: bool = True
    bundle: bool = True
    huber_px: float = 3.0
    render_scale: float = 1.0
    seam_scale: float = 0.25
    exposure: str = "blocks"
    seam: str = "graphcut"
    blend: str = "multiband"
    blend_strength: float = 5.0
    max_megapixels: float = 220.0
    crop: bool = True
    seam_debug_path: str | None = None

    def __post_init__(self) -> None:
        for name, allowed in (("detector", KINDS), ("exposure", B.EXPOSURES), ("seam", B.SEAMS), ("blend", B.BLENDS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} {getattr(self, name)!r}: one of {', '.join(allowed)}")


@dataclass
class Geometry:
    """Tables of the geometric part, each cut from its lineage."""

    images: DataFrame
    work: DataFrame
    features: DataFrame
    scored: DataFrame
    pairs: DataFrame
    layout: DataFrame
    rescued: DataFrame | None = None  # store, i, j of pairs that the rescuer saved

    def errors(self) -> DataFrame:
        """store, idx, error: photographs whose features failed, and (idx null) stores whose layout did."""
        one = self.features.where("error IS NOT NULL").select("store", "idx", "error")
        return one.unionByName(self.layout.where("error IS NOT NULL").groupBy("store").agg(F.max("error").alias("error")).select("store", F.lit(None).cast("int").alias("idx"), "error"))


#: A matcher for pairs that join separate components: (pairs, work) -> pairs of the same columns. Those with `confident`
#: (how many of its matches it is sure of, see matching.confident) are judged here, by its own gates; others by it.
Rescuer = Callable[[DataFrame, DataFrame], DataFrame]


def gated(found: DataFrame, work: DataFrame, cfg: "Config") -> DataFrame:
    """A rescuer's pairs with ok and reason by rescue_reason(): confident matches, plausibility, inliers, ratio, overlap, correlation, in this order."""
    size = work.select("store", F.col("idx").alias("i"), F.col("w").cast("double").alias("_w"), F.col("h").cast("double").alias("_h"))
    why = F.when(F.col("h").isNotNull(), implausible(P.nine("h"), F.col("_w"), F.col("_h")))
    reason = rescue_reason(F.col("confident"), F.col("n_inliers"), why, F.col("overlap"), F.col("ncc"), min_inliers=cfg.min_inliers, min_ratio=cfg.min_inlier_ratio, min_overlap=cfg.min_overlap, min_ncc=cfg.min_ncc)
    judged = found.join(size, ["store", "i"]).withColumn("reason", reason).withColumn("ok", F.col("reason") == "loftr")
    n = F.col("confident").cast("int")
    judged = judged.withColumns({"n_matches": n, "inlier_ratio": F.coalesce(F.try_divide(F.col("n_inliers").cast("double"), n), F.lit(0.0))})
    return judged.withColumn("score", edge_score(F.col("ok"), F.col("n_inliers"), F.col("ncc"))).select([c for c in found.columns if c != "confident"])


def bridges(pairs: DataFrame, layout: DataFrame) -> DataFrame:
    """Failed pairs whose images lie in different components, the best correlated first."""
    comp = layout.select("store", "idx", "component")
    end = lambda s: comp.select("store", F.col("idx").alias(s), F.col("component").alias(f"_{s}"))
    return pairs.where("NOT ok").join(end("i"), ["store", "i"]).join(end("j"), ["store", "j"]).where("_i <> _j").drop("_i", "_j").orderBy(F.col("ncc").desc(), "store", "i", "j")


def rescued(pairs: DataFrame, layout: DataFrame, work: DataFrame, rescue: Rescuer, cfg: "Config | None" = None) -> tuple[DataFrame, DataFrame]:
    """(pairs with those that the rescuer saved, the saved ones). Pairs that it found but that don't pass keep its reason.

    Round by round, each store's most promising bridge goes to the rescuer. If it is saved,
    components are found anew, so other bridges to an image that is joined aren't paid for;
    if not, the next one is tried. A pair is tried once.
    """
    keys, tried, saved = ["store", "i", "j"], None, None
    while True:
        left = bridges(pairs, layout)
        if tried is not None:
            left = left.join(tried, keys, "left_anti")
        turn = F.row_number().over(W.partitionBy("store").orderBy(F.col("ncc").desc(), "i", "j"))
        first = _kept(left.withColumn("_t", turn).where("_t = 1").drop("_t"))
        if not first.limit(1).count():
            return pairs, pairs.limit(0) if saved is None else saved
        tried = first.select(keys) if tried is None else _kept(tried.unionByName(first.select(keys)))
        found = rescue(first, work)
        found = _kept(gated(found, work, cfg or Config()) if "confident" in found.columns else found)
        good, why = found.where("ok"), found.where("NOT ok AND reason LIKE 'loftr: %'").select(*keys, F.col("reason").alias("_why"))
        if why.limit(1).count():
            pairs = _kept(pairs.join(why, keys, "left").withColumn("reason", F.coalesce("_why", "reason")).drop("_why"))
        if good.limit(1).count():
            saved = good if saved is None else _kept(saved.unionByName(good))
            pairs = _kept(replaced(pairs, good, keys))
            layout = _kept(P.layouts(work, pairs, adjust=False))


def solve(images: DataFrame, cfg: Config, rescue: Rescuer | None = None) -> Geometry:
    """Features, pairs and layouts of all stores. rescue: tried on bridges between components, if any."""
    work = _kept(S.work_images(images, cfg.work_max_dim))
    feats = _kept(P.features(work, cfg.detector, cfg.n_features))
    modes = _kept(P.pair_modes(feats, ratio=cfg.ratio, within=cfg.ransac_thresh, least=cfg.min_inliers, most=cfg.n_hypotheses))
    scored = _kept(P.judged(modes, work, gate=cfg.plausibility_gate, least=cfg.min_inliers, min_overlap=cfg.min_overlap, polish=cfg.ecc_refine))
    pairs = _kept(P.accepted(scored, least=cfg.min_inliers, min_ratio=cfg.min_inlier_ratio, min_ncc=cfg.min_ncc, min_overlap=cfg.min_overlap))
    layout = _kept(P.layouts(work, pairs, adjust=cfg.bundle, huber=cfg.huber_px))
    saved = None
    if rescue is not None and cfg.use_deep_fallback:
        pairs, saved = rescued(pairs, layout, work, rescue, cfg)
        if saved.limit(1).count():
            layout = _kept(P.layouts(work, pairs, adjust=cfg.bundle, huber=cfg.huber_px))
    return Geometry(images, work, feats, scored, pairs, layout, saved)


def render(g: Geometry, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(mosaic tiles, canvas plan, cuts with shares, small warped images) of all stores."""
    plan = _kept(C.canvas(g.work, g.layout, cfg.render_scale, cfg.max_megapixels))
    small = _kept(C.thumbs(g.images, plan, cfg.seam_scale))
    cut = _kept(C.cuts(small, cfg.exposure, cfg.seam))
    mosaic = _kept(C.tiles(g.images, plan, cut, blend=cfg.blend, strength=cfg.blend_strength, seam_scale=cfg.seam_scale))
    return mosaic, plan, cut, small


def report(g: Geometry, cut: DataFrame, plan: DataFrame, mosaic: DataFrame | None = None) -> DataFrame:
    """One row per store: counts, names in order, dropped names, pairs, shares, metrics, canvas; nested, ready for JSON.

    mosaic: for the share of the canvas that is covered. error: why a store has no mosaic
    (its layout, its cuts or a tile failed), else null; image_errors: photographs that failed alone.
    """
    names = g.work.select("store", "idx", "name")
    at = names.join(g.layout.select("store", "idx", "position", "component", "is_anchor", "rms_before", "rms_after"), ["store", "idx"])
    by = lambda key, when=None: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(key, "name")) if when is not None else F.struct(key, "name"))), lambda s: s["name"])
    used = F.col("position").isNotNull()
    base = at.groupBy("store").agg(F.count("*").alias("n_images"), F.count("position").alias("n_images_used"), by("idx").alias("images"), by("position", used).alias("order"), by("idx", ~used).alias("dropped_images"), F.max(F.when(F.col("is_anchor"), F.col("name"))).alias("anchor"), F.max("rms_before").alias("bundle_rms_before"), F.max("rms_after").alias("bundle_rms_after"))
    comps = at.groupBy("store", "component").agg(by("idx").alias("names")).groupBy("store").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "names"))), lambda s: s["names"]).alias("components"))
    short = lambda s: names.select("store", F.col("idx").alias(s), F.substring("name", 1, 8).alias(f"n_{s}"))
    item = F.struct(F.col("n_i").alias("i"), F.col("n_j").alias("j"), "ok", F.col("n_inliers").alias("inliers"), F.round("inlier_ratio", 3).alias("inlier_ratio"), F.round("overlap", 3).alias("overlap"), F.round("ncc", 3).alias("ncc"), F.round("score", 1).alias("score"), "reason")
    pairs = g.pairs.join(short("i"), ["store", "i"]).join(short("j"), ["store", "j"]).groupBy("store").agg(F.count_if("ok").alias("n_pairs_verified"), F.transform(F.array_sort(F.collect_list(F.struct(F.col("i").alias("a"), F.col("j").alias("b"), item.alias("pair")))), lambda s: s["pair"]).alias("pairs"))
    shares = cut.groupBy("store").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.round("share", 4).alias("share"))))).alias("source_pixel_share"), F.array_sort(F.collect_list(F.when(F.col("share") < 0.01, F.col("name")))).alias("low_contribution"))
    size = plan.groupBy("store").agg(F.max("cw").alias("canvas_w"), F.max("ch").alias("canvas_h"), F.max("render_scale").alias("render_scale"))
    errors, agreement = _kept(P.residuals(g.layout, g.pairs)), _kept(P.layout_agreement(g.work, g.layout, g.pairs))
    m = _kept(P.layout_metrics(g.work, g.layout, g.pairs, errors, agreement))
    rounded = m.select("store", F.struct("n_pairs_scored", *[F.round(c, 3).alias(c) for c in m.columns if c not in ("store", "n_pairs_scored")]).alias("metrics"))
    each = P.pair_metrics(g.layout, g.pairs, g.work, errors, agreement).join(short("i"), ["store", "i"]).join(short("j"), ["store", "j"])
    each = each.select("store", "i", "j", F.struct(F.concat("n_i", F.lit("->"), "n_j").alias("pair"), *[F.round(c, 3).alias(c) for c in ("reproj_rms_px", "reproj_median_px", "overlap_ncc", "overlap_frac")], "n_points").alias("m"))
    each = each.groupBy("store").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "m"))), lambda s: s["m"]).alias("per_pair"))
    base = base.join(each, "store", "left")
    if g.rescued is not None:
        again = g.rescued.join(short("i"), ["store", "i"]).join(short("j"), ["store", "j"]).groupBy("store").agg(F.array_sort(F.collect_list(F.concat("n_i", F.lit("->"), "n_j"))).alias("deep_rescued_pairs"))
        base = base.join(again, "store", "left")
    failed = g.features.where("error IS NOT NULL").join(names, ["store", "idx"]).groupBy("store").agg(F.array_sort(F.collect_list(F.concat("name", F.lit(": "), "error"))).alias("image_errors"))
    faults = [t.where("error IS NOT NULL").select("store", "error") for t in (g.layout, cut, *([mosaic] if mosaic is not None else []))]
    every = faults[0]
    for f in faults[1:]:
        every = every.unionByName(f)
    base = base.join(failed, "store", "left").join(every.groupBy("store").agg(F.max("error").alias("error")), "store", "left")
    if mosaic is not None:
        stats = C.canvas_statistics(mosaic, plan).select("store", F.struct("canvas_px", "covered_px", F.round("coverage", 4).alias("coverage")).alias("canvas"))
        base = base.join(stats, "store", "left")
    out = base.join(comps, "store", "left").join(pairs, "store", "left").join(shares, "store", "left").join(size, "store", "left").join(rounded, "store", "left")
    return out.withColumn("n_pairs_verified", F.coalesce("n_pairs_verified", F.lit(0)))


def stitch(spark: SparkSession, images: DataFrame, cfg: Config | None = None, rescue: Rescuer | None = None):
    """(tiles, reports, geometry, seam maps or None) of every store of read_images()."""
    cfg = cfg or Config()
    g = solve(images, cfg, rescue)
    mosaic, plan, cut, small = render(g, cfg)
    return mosaic, report(g, cut, plan, mosaic), g, C.seam_map(small, cut)


def stitch_store(spark: SparkSession, folder: str, cfg: Config | None = None, rescue: Rescuer | None = None) -> tuple[np.ndarray, dict]:
    """One folder's mosaic (BGR) and its report. A single photograph comes back as it is; no photograph is an error."""
    cfg, t = cfg or Config(), time.time()
    names = S.list_images(spark, folder)
    first = names.orderBy("idx").limit(2).collect()
    if not first:
        raise FileNotFoundError(f"no photographs in {folder}")
    images = S.read_images(spark, folder)
    if len(first) == 1:
        r = images.first()
        nothing = {"pairs": [], "n_pairs_verified": 0, "components": [], "dropped_images": [], "anchor": "", "order": [], "metrics": {}, "per_pair": [], "deep_rescued_pairs": [], "bundle_rms_before": None, "bundle_rms_after": None}
        return P.pixels(r.bgr, r.full_h, r.full_w), {"store": r.store, "n_images": 1, "n_images_used": 1, "images": [r.name], **nothing, "output_shape": [r.full_h, r.full_w, 3], "seconds": round(time.time() - t, 1)}
    mosaic, reports, _, seams = stitch(spark, images, cfg, rescue)
    rep = reports.first().asDict(recursive=True)
    if rep["error"]:
        raise RuntimeError(rep["error"])
    out = C.assembled(mosaic, first[0].store, cfg.crop)
    if cfg.seam_debug_path:
        s = seams.first()
        S.write_image(spark, cfg.seam_debug_path, P.pixels(s.bgr, s.h, s.w))
    return out, rep | {"output_shape": list(out.shape), "seconds": round(time.time() - t, 1)}


def run_and_save(spark: SparkSession, folder: str, out: str, cfg: Config | None = None, report_path: str | None = None, quality: int = 95) -> dict:
    cfg = cfg or Config()
    image, rep = stitch_store(spark, folder, cfg)
    S.write_image(spark, out, image, quality)
    if report_path:
        S.write_report(spark, report_path, {"config": asdict(cfg), "report": rep})
    return rep


def outputs(out: str, store: str | None = None) -> dict[str, str]:
    """Where a run's picture, report and seam map go: in a folder by the store's name, or beside the picture that `out` names."""
    if store:  # fixed: names of a batch's files
        return {"picture": f"{out}/{store}_stitched.jpg", "report": f"{out}/{store}_report.json", "seams": f"{out}/{store}_seams.jpg"}
    picture = out if re.search(r"\.(jpe?g|png)$", out, re.I) else f"{out.rstrip('/')}/stitched.jpg"
    base, _ = os.path.splitext(picture)
    return {"picture": picture, "report": base + "_report.json", "seams": base + "_seams.jpg"}


def run_many(spark: SparkSession, root: str, out: str, cfg: Config | None = None, reports: bool = True, quality: int = 95, seams: bool = False) -> list[dict]:
    """Every store_*/images folder in one plan; the driver only writes, one store at a time. Undecodable files are skipped.

    Kernels that fail leave their error as a value, so a photograph costs its own row, a
    pair its pair, and a store (store, n_images, n_images_used = 0, error) its mosaic, while
    the plan runs once for all. Only if the job itself is lost (a worker that dies, no
    memory) do stores run one by one, and those that are lost again are such rows too.
    """
    cfg = cfg or Config()
    images = S.read_images(spark, root, many=True, on_bad="skip")
    try:
        return _saved(spark, images, out, cfg, reports, quality, seams)
    except LOST as e:
        if isinstance(e, AnalysisException):
            raise
        first = str(e)
    done = []
    for r in S.list_images(spark, root, many=True).groupBy("store").count().orderBy("store").toLocalIterator():
        try:
            done += _saved(spark, images.where(F.col("store") == r.store), out, cfg, reports, quality, seams)
        except LOST as e:
            done.append({"store": r.store, "n_images": r["count"], "n_images_used": 0, "error": (str(e) or first)[:500]})
    return done


def _saved(spark: SparkSession, images: DataFrame, out: str, cfg: Config, reports: bool, quality: int, seams: bool) -> list[dict]:
    mosaic, table, _, maps = stitch(spark, images, cfg)
    done = []
    for r in _kept(table).orderBy("store").toLocalIterator():
        rep, to = r.asDict(recursive=True), outputs(out, r.store)
        if rep["error"]:
            done.append({"store": r.store, "n_images": r.n_images, "n_images_used": 0, "error": rep["error"]})
            continue
        image = C.assembled(mosaic, r.store, cfg.crop)
        S.write_image(spark, to["picture"], image, quality)
        if reports:
            S.write_report(spark, to["report"], {"config": asdict(cfg), "report": rep | {"output_shape": list(image.shape)}})
        if seams:
            s = maps.where(F.col("store") == r.store).first()
            S.write_image(spark, to["seams"], P.pixels(s.bgr, s.h, s.w), quality)
        done.append(rep)
    return done


def bundled(spark: SparkSession, image: np.ndarray, rep: dict, seams: np.ndarray | None = None, quality: int = 95) -> bytes:
    """A ZIP file of a mosaic, its report and, if there is one, its seam map."""
    parts = {"panorama.jpg": S.encode(spark, image, "jpg", quality), "report.json": json.dumps(rep, indent=2, default=str).encode()}
    return S.bundle(parts | ({} if seams is None else {"seam_map.jpg": S.encode(spark, seams, "jpg", quality)}))


#: What each ablation changes.
ABLATIONS: dict[str, dict] = {
    "full pipeline": {},
    "ORB instead of SIFT": {"detector": "orb"},
    "plain SIFT": {"detector": "sift"},
    "ratio 0.70": {"ratio": 0.70},
    "single-hypothesis RANSAC": {"n_hypotheses": 1},
    "no photometric gate": {"min_ncc": -1.0},
    "no bundle adjustment": {"bundle": False},
    "+ ECC polish": {"ecc_refine": True},
    "no LoFTR fallback": {"use_deep_fallback": False},
    "2000 features": {"n_features": 2000},
    "no plausibility gate": {"plausibility_gate": False},
}
#: Changes that only pictures show; for ablate(..., out=).
RENDERINGS: dict[str, dict] = {
    "render_full": {},
    "render_no_seam_no_blend": {"seam": "none", "blend": "none"},
    "render_voronoi_feather": {"seam": "voronoi", "blend": "feather"},
    "render_no_exposure": {"exposure": "none"},
    "render_graphcut_feather": {"blend": "feather"},
}


def ablate(spark: SparkSession, root: str, changes: dict[str, dict] | None = None, out: str | None = None, quality: int = 88, log: str | None = None) -> DataFrame:
    """config, store, n, used, rms, ncc, min_ncc, seconds, error: geometry of all stores under each change.

    A store that fails is a row with its error, and leaves the others' rows as they are; a
    change of which the whole job is lost is one row. seconds: the whole change's, shared
    out evenly over its stores, so that sums over stores are the change's.

    With `out`, the changes (RENDERINGS, if none are given) are rendered as well, to <out>/<config>_<store>.jpg.
    log: where the rows go as a JSON list, too.
    """
    rows = []
    for name, change in ((RENDERINGS if out else ABLATIONS) if changes is None else changes).items():
        t = time.time()
        try:
            cfg = Config(**change)
            g = solve(S.read_images(spark, root, many=True, on_bad="skip"), cfg)
            faults = {r.store: r.error for r in g.layout.where("error IS NOT NULL").groupBy("store").agg(F.max("error").alias("error")).toLocalIterator()}
            if out:
                mosaic, plan, cut, _ = render(g, cfg)
                bad = cut.where("error IS NOT NULL").select("store", "error").unionByName(mosaic.where("error IS NOT NULL").select("store", "error"))
                faults |= {r.store: r.error for r in bad.groupBy("store").agg(F.max("error").alias("error")).toLocalIterator()}
                for r in plan.select("store").distinct().toLocalIterator():
                    if r.store not in faults:
                        S.write_image(spark, f"{out}/{name}_{r.store}.jpg", C.assembled(mosaic, r.store, cfg.crop), quality)
            used = g.layout.groupBy("store").agg(F.count("*").alias("n"), F.count("h").alias("used"))
            found = used.join(P.layout_metrics(g.work, g.layout, g.pairs), "store").orderBy("store").collect()  # a row a store
            each = (time.time() - t) / max(len(found), 1)
            rows += [(name, r.store, r.n, r.used, r.reproj_rms_px, r.mean_overlap_ncc, r.min_overlap_ncc, each, faults.get(r.store)) for r in found]
        except Exception as e:  # noqa: BLE001 - one configuration's failure is a result
            rows.append((name, None, None, None, None, None, None, time.time() - t, str(e)[:500]))
    if log:
        names = ("config", "store", "n", "used", "rms", "ncc", "min_ncc", "seconds", "error")
        S.write_report(spark, log, [dict(zip(names, r, strict=True)) for r in rows])
    return spark.createDataFrame(rows, "config string, store string, n long, used long, rms double, ncc double, min_ncc double, seconds double, error string")


def summary(runs: DataFrame) -> DataFrame:
    """A row per configuration: sums of images and seconds, means of stores' rms and ncc, the least ncc; stores that failed count for images and seconds alone."""
    return runs.groupBy("config").agg(F.sum("used").alias("used"), F.sum("n").alias("n"), F.avg("rms").alias("rms"), F.avg("ncc").alias("ncc"), F.min("min_ncc").alias("min_ncc"), F.sum("seconds").alias("seconds"))
