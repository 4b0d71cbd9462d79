"""Command line: python -m mosaiq --images DIR | --data-root DIR.

Ends with 0 if every photograph found its place, 2 if some did not, 1 if there was nothing to do.
"""

from __future__ import annotations

import argparse

from mosaiq.kernels import blend as B
from mosaiq.kernels.detect import KINDS
from mosaiq.plans.mosaic import Config, outputs, run_and_save, run_many


#: Flags, choices and defaults.
def parser() -> argparse.ArgumentParser:
    d, p = Config(), argparse.ArgumentParser(prog="python -m mosaiq", description="Joins photographs of one plane into a mosaic.")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--images", help="folder of one store's photographs")
    source.add_argument("--data-root", help="folder that holds store_*/images")
    p.add_argument("--out", default="outputs")
    p.add_argument("--report", action=argparse.BooleanOptionalAction, default=True)
    for name in ("work_max_dim", "n_features", "ratio", "ransac_thresh", "min_inliers", "min_inlier_ratio", "min_ncc", "min_overlap", "n_hypotheses", "huber_px", "render_scale", "seam_scale", "blend_strength", "max_megapixels"):
        p.add_argument("--" + name.replace("_", "-"), type=type(getattr(d, name)), default=getattr(d, name))
    for name, kinds in (("detector", KINDS), ("exposure", B.EXPOSURES), ("seam", B.SEAMS), ("blend", B.BLENDS)):
        p.add_argument("--" + name, choices=kinds, default=getattr(d, name))
    p.add_argument("--ecc", dest="ecc_refine", action="store_true")
    for flag, name in (("--no-plausibility-gate", "plausibility_gate"), ("--no-deep", "use_deep_fallback"), ("--no-bundle", "bundle"), ("--no-crop", "crop")):
        p.add_argument(flag, dest=name, action="store_false")
    p.add_argument("--debug-seams", action="store_true")
    p.add_argument("--quiet", action="store_true")
    return p


def config(a: argparse.Namespace) -> Config:
    return Config(**{k: v for k, v in vars(a).items() if k in Config.__dataclass_fields__})


def main(argv: list[str] | None = None) -> int:
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    a = parser().parse_args(argv)
    cfg = config(a)
    spark = SparkSession.builder.getOrCreate()
    if a.images:
        to = outputs(a.out)
        cfg.seam_debug_path = to["seams"] if a.debug_seams else None
        done = [run_and_save(spark, a.images, to["picture"], cfg, to["report"] if a.report else None)]
    else:
        try:
            done = run_many(spark, a.data_root, a.out.rstrip("/"), cfg, a.report, seams=a.debug_seams)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = []
    if not a.quiet:
        for r in done:
            print(f"{r['store']}: {r.get('error') or str(r['n_images_used']) + ' of ' + str(r['n_images']) + ' placed'}")
    return status(done)


def status(done: list[dict]) -> int:
    """What the process ends with."""
    if not done:
        return 1
    return 2 if any(r["n_images_used"] < r["n_images"] for r in done) else 0
