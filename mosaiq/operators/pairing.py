"""From photographs to accepted pairs and layouts: features, matches, modes, gates, trees, adjustment."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mosaiq.functions.homography import corners, dehomogenised, implausible, inverse, product
from mosaiq.kernels import fit
from mosaiq.kernels.detect import detect
from mosaiq.kernels.raster import apply, correlation, frame
from mosaiq.operators import adjust as A
from mosaiq.operators.evaluate import pair_scores, residual_metrics, residual_metrics_of_any_size
from mosaiq.operators.forest import framed, spanning
from mosaiq.operators.graph import FEW, both_ways, components, dealt, kept, looked_up, ranked_within
from mosaiq.operators.matching import edge_score
from mosaiq.operators.reach import anchors

_PAIR = "store string, i int, j int, mode_no int, n_matches int, n_inliers int, h array<double>, pts binary, error string"
_MODE = "struct<mode_no:int,n_inliers:int,h:array<double>,pts:binary,why:string,ncc:double,overlap:double>"


def pixels(data: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, 3)


def fault(e: Exception) -> str:
    """A kernel's failure as a value: it costs its own row only."""
    return f"{type(e).__name__}: {e}"[:300]


def features(work: DataFrame, kind: str = "rootsift", most: int = 12000) -> DataFrame:
    """store, idx, n, xy, response, desc, error: a row per image, its keypoints packed (float64, float64, float32); none where it fails."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for r in df.itertuples(index=False):
                try:
                    xy, s, d = detect(pixels(r.bgr, r.h, r.w), kind, most)
                    out.append((r.store, r.idx, len(xy), xy.astype(float).tobytes(), s.astype(float).tobytes(), d.tobytes(), None))
                except Exception as e:  # noqa: BLE001
                    out.append((r.store, r.idx, 0, b"", b"", b"", fault(e)))
            yield pd.DataFrame(out, columns=["store", "idx", "n", "xy", "response", "desc", "error"])

    return dealt(work.select("store", "idx", "h", "w", "bgr"), "store", "idx").mapInPandas(run, "store string, idx int, n int, xy binary, response binary, desc binary, error string")


def keypoints(packed: DataFrame) -> DataFrame:
    """store, idx, kp, x, y, response, desc: a row per keypoint."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            for r in df.itertuples(index=False):
                xy = np.frombuffer(r.xy).reshape(-1, 2)
                d = np.frombuffer(r.desc, np.float32).reshape(r.n, -1) if r.n else np.zeros((0, 1), np.float32)
                yield pd.DataFrame({"store": r.store, "idx": r.idx, "kp": range(r.n), "x": xy[:, 0], "y": xy[:, 1], "response": np.frombuffer(r.response), "desc": list(d)})

    return packed.mapInPandas(run, "store string, idx int, kp int, x double, y double, response double, desc array<float>")


def _nearest(a: np.ndarray, b: np.ndarray, block: int = 1024):
    best, one, two = [], [], []
    sq = (b * b).sum(1)
    for k in range(0, len(a), block):
        x = a[k : k + block]
        d = np.maximum((x * x).sum(1)[:, None] + sq - 2 * x @ b.T, 0)
        r, i = np.arange(len(d)), d.argmin(1)
        best.append(i)
        one.append(d[r, i].copy())
        d[r, i] = np.inf
        two.append(d.min(1))
    return np.concatenate(best), np.sqrt(np.concatenate(one)), np.sqrt(np.concatenate(two))


def matched(a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    """(m, 2) places of rows that are each other's nearest, both under `ratio` times the second nearest."""
    if len(a) < 2 or len(b) < 2:
        return np.zeros((0, 2), int)
    ab, d1, d2 = _nearest(a, b)
    ba, e1, e2 = _nearest(b, a)
    k = np.flatnonzero((d1 < ratio * d2) & (ba[ab] == np.arange(len(a))) & (e1 < ratio * e2)[ab])
    return np.stack([k, ab[k]], 1)


def pair_modes(packed: DataFrame, *, ratio: float = 0.85, within: float = 3.0, least: int = 40, most: int = 6) -> DataFrame:
    """A row per homography that fits matches of two images of a store (i < j); mode_no is -1 if none does, or if it fails (error).

    Each pair of images is one row that meets both packed sides, so keypoints are never
    shuffled one by one and a large store is spread over all tasks. Chance depends on store, i and j alone.
    """
    one = packed.select("store", F.col("idx").alias("i"), F.col("n").alias("n_i"), F.col("xy").alias("xy_i"), F.col("desc").alias("d_i"))
    two = packed.select("store", F.col("idx").alias("j"), F.col("n").alias("n_j"), F.col("xy").alias("xy_j"), F.col("desc").alias("d_j"))
    ids = packed.select("store", "idx")
    pairs = ids.withColumnRenamed("idx", "i").join(ids.withColumnRenamed("idx", "j"), "store").where("i < j")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for r in df.itertuples(index=False):
                try:
                    m = np.zeros((0, 2), int)
                    if r.n_i > 1 and r.n_j > 1:
                        m = matched(np.frombuffer(r.d_i, np.float32).reshape(r.n_i, -1), np.frombuffer(r.d_j, np.float32).reshape(r.n_j, -1), ratio)
                    a, b = np.frombuffer(r.xy_i).reshape(-1, 2)[m[:, 0]], np.frombuffer(r.xy_j).reshape(-1, 2)[m[:, 1]]
                    found = fit.modes(a, b, zlib.crc32(f"{r.store}/{r.i}/{r.j}".encode()), most, least, within) if len(m) >= least else []
                    for k, (h, good) in enumerate(found):
                        out.append((r.store, r.i, r.j, k, len(m), len(good), h.ravel().tolist(), np.concatenate([a[good], b[good]], 1).tobytes(), None))
                    if not found:
                        out.append((r.store, r.i, r.j, -1, len(m), 0, None, None, None))
                except Exception as e:  # noqa: BLE001
                    out.append((r.store, r.i, r.j, -1, 0, 0, None, None, fault(e)))
            yield pd.DataFrame(out, columns=["store", "i", "j", "mode_no", "n_matches", "n_inliers", "h", "pts", "error"])

    return dealt(pairs.join(one, ["store", "i"]).join(two, ["store", "j"]), "store", "i", "j").mapInPandas(run, _PAIR)


def nine(h: str | Column) -> list[Column]:
    c = F.col(h) if isinstance(h, str) else h
    return [c[k] for k in range(9)]


def judged(modes: DataFrame, work: DataFrame, *, gate: bool = True, least: int = 40, min_overlap: float = 0.04, polish: bool = False) -> DataFrame:
    """store, i, j, n_matches, modes (array), error: each mode with why ('ok' or its fault), ncc and overlap; no modes where it fails.

    The geometric gate is made of columns and comes first; pixels are only compared for modes
    that pass. polish: the best viable mode is moved for a higher correlation, and kept if it has one.
    """
    size = work.select("store", F.col("idx").alias("i"), F.col("w").cast("double").alias("_w"), F.col("h").cast("double").alias("_h"))
    why = F.when(F.col("h").isNull(), F.lit(None)).otherwise(implausible(nine("h"), F.col("_w"), F.col("_h")) if gate else F.lit("ok"))
    item = F.struct("mode_no", "n_inliers", "h", "pts", "why", F.lit(0.0).alias("ncc"), F.lit(0.0).alias("overlap"))
    flat = modes.join(size, ["store", "i"]).withColumn("why", why)
    rows = flat.groupBy("store", "i", "j", "n_matches").agg(F.array_sort(F.collect_list(F.when(F.col("mode_no") >= 0, item))).alias("modes"), (F.max("error") if "error" in modes.columns else F.lit(None).cast("string")).alias("error"))
    px = work.select("store", "idx", "h", "w", "bgr")
    side = lambda s: px.select("store", F.col("idx").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("h", "w", "bgr")])

    def judge(r) -> list[dict]:
        a, b, got = pixels(r.bgr_i, r.h_i, r.w_i), pixels(r.bgr_j, r.h_j, r.w_j), []
        for m in (m.asDict() if hasattr(m, "asDict") else dict(m) for m in r.modes):
            m["h"] = [float(v) for v in m["h"]]
            if m["why"] == "ok":
                m["ncc"], m["overlap"] = correlation(a, b, np.array(m["h"]).reshape(3, 3))
            got.append(m)
        fine = [m for m in got if m["why"] == "ok" and m["overlap"] >= min_overlap and m["n_inliers"] >= least]
        if polish and fine:
            best = max(fine, key=lambda m: (m["ncc"], -m["mode_no"]))
            h = fit.polished(a, b, np.array(best["h"]).reshape(3, 3))
            if h is not None:
                ncc, overlap = correlation(a, b, h)
                if ncc > best["ncc"] and overlap >= min_overlap:
                    best.update(h=h.ravel().tolist(), ncc=ncc, overlap=overlap)
        return got

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for r in df.itertuples(index=False):
                try:
                    got, error = judge(r), None
                except Exception as e:  # noqa: BLE001
                    got, error = [], fault(e)
                out.append((r.store, r.i, r.j, r.n_matches, got, error))
            yield pd.DataFrame(out, columns=["store", "i", "j", "n_matches", "modes", "error"])

    none = rows.where(F.size("modes") == 0)
    some = rows.where(F.size("modes") > 0).join(side("i"), ["store", "i"]).join(side("j"), ["store", "j"]).select("store", "i", "j", "n_matches", "modes", "h_i", "w_i", "bgr_i", "h_j", "w_j", "bgr_j")
    done = dealt(some, "store", "i", "j").mapInPandas(run, f"store string, i int, j int, n_matches int, modes array<{_MODE}>, error string")
    return done.unionByName(none.select("store", "i", "j", "n_matches", F.col("modes").cast(f"array<{_MODE}>").alias("modes"), "error"))


def accepted(scored: DataFrame, *, least: int = 40, min_ratio: float = 0.1, min_ncc: float = 0.25, min_overlap: float = 0.04) -> DataFrame:
    """store, i, j, h, n_matches, n_inliers, inlier_ratio, overlap, ncc, score, ok, reason, pts: one row a pair.

    The viable mode of the highest correlation wins (ties: the earliest), then gates apply in order.
    Without a viable mode, the best of the others stays and names its fault.
    """
    viable = lambda m: (m["why"] == "ok") & (m["overlap"] >= min_overlap) & (m["n_inliers"] >= least)
    best = lambda ms: F.reduce(ms, F.element_at(ms, 1), lambda a, m: F.when(m["ncc"] > a["ncc"], m).otherwise(a))
    plausible = F.filter("modes", lambda m: m["why"] == "ok")
    held = scored if "error" in scored.columns else scored.withColumn("error", F.lit(None).cast("string"))
    d = held.withColumn("_v", F.filter("modes", viable)).withColumn("_p", plausible)
    # without a viable one: the first mode (0, if it is implausible), unless a plausible one has a higher correlation
    head = F.element_at("modes", 1)
    tried = F.filter("modes", lambda m: (m["why"] == "ok") | (m["mode_no"] == head["mode_no"]))
    pick = F.when(F.size("_v") > 0, best(F.col("_v"))).when(F.size("modes") > 0, best(tried))
    d = d.withColumn("m", pick).withColumn("inlier_ratio", F.coalesce(F.try_divide(F.col("m.n_inliers").cast("double"), "n_matches"), F.lit(0.0)))
    why = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("failed: "), "error"))
        .when(F.col("n_matches") < least, F.format_string("only %d raw matches", "n_matches"))
        .when(F.size("modes") == 0, "no homography with enough inliers")
        .when((F.size("_v") == 0) & (F.col("m.why") != "ok"), F.col("m.why"))
        .when(F.size("_v") == 0, F.format_string("overlap %.3f < %.3f", F.col("m.overlap"), F.lit(min_overlap)))
        .when(F.col("inlier_ratio") < min_ratio, F.format_string("inlier ratio %.3f < %.3f", "inlier_ratio", F.lit(min_ratio)))
        .when(F.col("m.ncc") < min_ncc, F.format_string("ncc %.3f < %.3f", F.col("m.ncc"), F.lit(min_ncc)))
    )
    note = F.when(F.col("m.mode_no") != F.col("_p")[0]["mode_no"], "ncc overruled top-inlier mode").otherwise("")
    d = d.withColumn("_f", why).withColumn("ok", F.col("_f").isNull())
    n, ncc = F.coalesce("m.n_inliers", F.lit(0)), F.coalesce("m.ncc", F.lit(0.0))
    return d.select("store", "i", "j", F.col("m.h").alias("h"), "n_matches", n.alias("n_inliers"), "inlier_ratio", F.coalesce("m.overlap", F.lit(0.0)).alias("overlap"), ncc.alias("ncc"), edge_score(F.col("ok"), n, ncc).alias("score"), "ok", F.coalesce("_f", note).alias("reason"), F.col("m.pts").alias("pts"))


def lay_out(nodes: list[int], edges: list[tuple[int, int, np.ndarray, float]]) -> tuple[dict[int, np.ndarray], int, list[list[int]]]:
    """Homographies into the anchor's frame for the largest component, its anchor, and all components.

    edges: (i, j, h from i to j, score). Anchor: the smallest hop eccentricity, then more edges, more
    score, the smaller image; homographies are composed along the strongest tree from it.
    """
    near: dict[int, dict[int, tuple[np.ndarray, float]]] = {v: {} for v in nodes}
    for i, j, h, s in edges:
        back = np.linalg.inv(h)
        near[i][j], near[j][i] = (h / h[2, 2], s), (back / back[2, 2], s)

    def reach(v):
        far, front = {v: 0}, [v]
        while front:
            front = [b for a in front for b in near[a] if far.setdefault(b, far[a] + 1) == far[a] + 1 and b not in front]
            front = list(dict.fromkeys(b for b in front if far[b] == max(far.values())))
        return far

    comps, left = [], set(nodes)
    while left:
        c = sorted(reach(min(left)))
        comps.append(c)
        left -= set(c)
    comps.sort(key=lambda c: (-len(c), c[0]))
    main = comps[0]
    anchor = max(main, key=lambda v: (-max(reach(v).values()), len(near[v]), sum(s for _, s in near[v].values()), -v))
    placed = {anchor: np.eye(3)}
    while len(placed) < len(main):
        s, a, b = max(((near[a][b][1], -a, -b) for a in placed for b in near[a] if b not in placed))
        h = placed[-a] @ near[-b][-a][0]
        placed[-b] = h / h[2, 2]
    return placed, anchor, comps


_LAYOUT = "store string, idx int, h array<double>, is_anchor boolean, position int, component int, rms_before double, rms_after double, error string"


def centroid(h: list[Column], w: Column, ht: Column) -> Column:
    """The mean x of an image's four corners under h: images go from left to right by it."""
    return sum((dehomogenised(h, x, y)[0] for x, y in corners(w, ht)[1:]), dehomogenised(h, *corners(w, ht)[0])[0]) / 4


def layouts(work: DataFrame, pairs: DataFrame, *, adjust: bool = True, huber: float = 3.0, most: int = 200, few: int = FEW) -> DataFrame:
    """store, idx, h, is_anchor, position, component, rms_before, rms_after, error: a row per image; h and position are null where it isn't placed.

    A store whose layout fails has none of its images placed, and says why in `error`. Stores of up to `most` images are laid out in a task each; larger ones by tables that
    meet in joins (large_layouts), so a store may have any number of images.
    """
    meta = work.select("store", "idx", "h", "w")
    good = pairs.where("ok AND h IS NOT NULL").select("store", "i", "j", "h", "ncc", "score", "pts")
    large = meta.groupBy("store").count().where(F.col("count") > most).select("store")
    if not large.limit(1).count():
        return small_layouts(meta, good, adjust=adjust, huber=huber)
    large, _ = kept(large)
    part = lambda df, how: df.join(F.broadcast(large) if large.count() <= few else large, "store", how)
    return small_layouts(part(meta, "left_anti"), part(good, "left_anti"), adjust=adjust, huber=huber).unionByName(large_layouts(part(meta, "left_semi"), part(good, "left_semi"), adjust=adjust, huber=huber, few=few))


def small_layouts(meta: DataFrame, good: DataFrame, *, adjust: bool = True, huber: float = 3.0) -> DataFrame:
    """layouts() of stores that fit into a task each: sizes of a store's images, and points of its accepted pairs."""

    cols = [c.split()[0] for c in _LAYOUT.split(", ")]

    def lay(m: pd.DataFrame, p: pd.DataFrame) -> list[tuple]:
        rows = [(r.i, r.j, np.array(r.h, float).reshape(3, 3), r.score) for r in p.itertuples()]
        h, anchor, comps = lay_out([int(v) for v in m["idx"]], rows)
        stats = {"rms_before": None, "rms_after": None}
        if adjust:
            pts = [(r.i, r.j, *np.split(np.frombuffer(r.pts).reshape(-1, 4), 2, 1), r.ncc) for r in p.itertuples()]
            h, stats = fit.adjusted(h, pts, anchor, huber, store=m["store"].iloc[0])
        size = {r.idx: (r.h, r.w) for r in m.itertuples()}
        order = sorted(h, key=lambda v: (apply(h[v], frame(*size[v]))[:, 0].mean(), v))
        place, comp = {v: k for k, v in enumerate(order)}, {v: k for k, c in enumerate(comps) for v in c}
        return [(m["store"].iloc[0], v, h[v].ravel().tolist() if v in h else None, v == anchor, place.get(v), comp[v], stats["rms_before"], stats["rms_after"], None) for v in m["idx"]]

    def run(m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        m, p = m.sort_values("idx"), p.sort_values(["i", "j"])
        try:
            rows = lay(m, p) if len(m) else []
        except Exception as e:  # noqa: BLE001
            rows = [(m["store"].iloc[0], v, None, False, None, k, None, None, fault(e)) for k, v in enumerate(m["idx"])]
        return pd.DataFrame(rows, columns=cols).astype({"position": "Int32"})

    return meta.groupBy("store").cogroup(good.groupBy("store")).applyInPandas(run, _LAYOUT)


def large_layouts(meta: DataFrame, good: DataFrame, *, adjust: bool = True, huber: float = 3.0, few: int = FEW) -> DataFrame:
    """layouts() of stores of any size: components, anchors, trees, adjustment and order are joins and partial sums over tables of numbered images."""
    nodes, _ = kept(meta.orderBy("store", "idx").withColumn("node", F.monotonically_increasing_id()))  # numbers ascend as images do
    number = lambda s: nodes.select("store", F.col("idx").alias(s), F.col("node").alias(f"n{s}"))
    edges, _ = kept(good.join(number("i"), ["store", "i"]).join(number("j"), ["store", "j"]).select("store", F.col("ni").alias("a"), F.col("nj").alias("b"), F.col("score").alias("weight"), "h", "pts", "ncc"))
    comp, _ = kept(components(nodes, edges, few))
    size, _ = kept(comp.groupBy("component").agg(F.count("*").alias("size")))
    own, _ = kept(looked_up(nodes.join(comp, "node"), ["component"], size, few))
    # components of a store: the largest first, of equals that of the smallest image
    turn, _ = kept(ranked_within(own.where("node = component").select("store", "component", (-F.col("size")).alias("by")), "store", ["by", "component"], "turn", few).select("component", "turn"))
    placed, _ = kept(looked_up(own, ["component"], turn, few))
    main, _ = kept(placed.where("turn = 0").select("node", "component"))
    inside = edges.join(main.select(F.col("node").alias("a")).hint("merge"), "a")
    both, _ = kept(both_ways(inside, "a", "b", [("strength", F.col("weight"), F.col("weight"))]))
    anchor, _ = kept(anchors(main, both, few).select("anchor"))
    _, at = spanning(inside, few=few, placed=True)
    frames = framed(at, anchor, few)
    alone = anchor.join(at.select(F.col("node").alias("anchor")), "anchor", "left_anti").select(F.col("anchor").alias("node"), "anchor", F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)]).alias("h"))
    start, _ = kept(frames.unionByName(alone).join(nodes.select("node", "store"), "node").select("store", "node", "h", (F.col("node") == F.col("anchor")).alias("fixed")))
    if adjust:
        moved, stats = A.adjusted(start, inside.select("store", F.col("a").alias("i"), F.col("b").alias("j"), "pts", "ncc"), huber=huber, few=few)
        moved = moved.select("node", "h").join(start.select("node", "fixed"), "node")
    else:
        moved, stats = start.select("node", "h", "fixed"), start.select("store", F.lit(None).cast("double").alias("rms_before"), F.lit(None).cast("double").alias("rms_after")).limit(0)
    moved, _ = kept(moved)
    wide = nodes.select("node", "store", F.col("h").cast("double").alias("ht"), F.col("w").cast("double").alias("wd")).join(moved, "node")
    order, _ = kept(ranked_within(wide.select("store", "node", centroid(nine("h"), F.col("wd"), F.col("ht")).alias("cx")), "store", ["cx", "node"], "position", few).select("node", "position"))
    out = placed.select("node", "store", "idx", "turn").join(moved, "node", "left").join(order, "node", "left")
    out = looked_up(out, ["store"], kept(stats.select("store", "rms_before", "rms_after"))[0], few)
    return out.select("store", "idx", "h", F.coalesce("fixed", F.lit(False)).alias("is_anchor"), F.col("position").cast("int").alias("position"), F.col("turn").cast("int").alias("component"), "rms_before", "rms_after", F.lit(None).cast("string").alias("error"))


def scorable(pairs: DataFrame, layout: DataFrame, keys: tuple[str, ...] = ("store",), n_points: Column | None = None, least: int = 4) -> DataFrame:
    """Pairs that are ok, have `least` points and both of whose ends are placed, with the ends' homographies as h_i and h_j.

    layout: keys, idx, h (null: not placed). n_points: how many points a pair has (by its packed `pts`, if not given).
    """
    n = F.length("pts") / 32 if n_points is None else n_points
    at = layout.where("h IS NOT NULL").select(*keys, "idx", "h")
    end = lambda s: at.select(*keys, F.col("idx").alias(s), F.col("h").alias(f"h_{s}"))
    good = pairs.where(F.col("ok") & (n >= least))
    return good.drop("h").join(end("i"), [*keys, "i"]).join(end("j"), [*keys, "j"])


def transfer(h_i: list[Column], h_j: list[Column]) -> list[Column]:
    """From i's pixels to j's under a layout: inverse(h_j) h_i."""
    return product(inverse(h_j), h_i)


def all_residuals(points: DataFrame, h_i: list[Column], h_j: list[Column], guard: float | None = None) -> DataFrame:
    """points (xi, yi, xj, yj, ...) with err: how far (xi, yi) lands from (xj, yj) under a layout. Without a guard, at infinity: null."""
    x, y = dehomogenised(transfer(h_i, h_j), F.col("xi"), F.col("yi"), guard)
    return points.withColumn("err", F.hypot(x - F.col("xj"), y - F.col("yj")))


def residuals(layout: DataFrame, pairs: DataFrame) -> DataFrame:
    """store, i, j, err: distance in j's pixels of each correspondence of scorable pairs under a layout."""

    def unpack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            for r in df.itertuples(index=False):
                q = np.frombuffer(r.pts).reshape(-1, 4)
                yield pd.DataFrame({"store": r.store, "i": r.i, "j": r.j, "h_i": [r.h_i] * len(q), "h_j": [r.h_j] * len(q), "xi": q[:, 0], "yi": q[:, 1], "xj": q[:, 2], "yj": q[:, 3]})

    points = scorable(pairs, layout).select("store", "i", "j", "h_i", "h_j", "pts").mapInPandas(unpack, "store string, i int, j int, h_i array<double>, h_j array<double>, xi double, yi double, xj double, yj double")
    return all_residuals(points, nine("h_i"), nine("h_j"), 1e-9).select("store", "i", "j", "err")


def layout_agreement(work: DataFrame, layout: DataFrame, pairs: DataFrame) -> DataFrame:
    """store, i, j, ncc, overlap of scorable pairs under the *layout*, not under the pair's own fit: an adjustment moves both."""
    px = work.select("store", "idx", "h", "w", "bgr")
    side = lambda s: px.select("store", F.col("idx").alias(s), *[F.col(c).alias(f"p{c}_{s}") for c in ("h", "w", "bgr")])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for r in df.itertuples(index=False):
                ncc, overlap = correlation(pixels(r.pbgr_i, r.ph_i, r.pw_i), pixels(r.pbgr_j, r.ph_j, r.pw_j), np.array(r.h, float).reshape(3, 3))
                out.append((r.store, r.i, r.j, ncc, overlap))
            yield pd.DataFrame(out, columns=["store", "i", "j", "ncc", "overlap"])

    both = scorable(pairs, layout).select("store", "i", "j", F.array(*transfer(nine("h_i"), nine("h_j"))).alias("h"))
    return dealt(both.join(side("i"), ["store", "i"]).join(side("j"), ["store", "j"]), "store", "i", "j").mapInPandas(run, "store string, i int, j int, ncc double, overlap double")


def pair_metrics(layout: DataFrame, pairs: DataFrame, work: DataFrame | None = None, errors: DataFrame | None = None, agreement: DataFrame | None = None) -> DataFrame:
    """store, i, j, n_points, reproj_rms_px, reproj_median_px, overlap_ncc, overlap_frac of scorable pairs under the layout; the last two need `work`, else null.

    errors, agreement: residuals() and layout_agreement(), if they are there already.
    """
    m = residual_metrics(residuals(layout, pairs) if errors is None else errors, ["store", "i", "j"], "err")
    if work is None:
        more = m.select("store", "i", "j", F.lit(None).cast("double").alias("overlap_ncc"), F.lit(None).cast("double").alias("overlap_frac"))
    else:
        more = (layout_agreement(work, layout, pairs) if agreement is None else agreement).withColumnsRenamed({"ncc": "overlap_ncc", "overlap": "overlap_frac"})
    return m.join(more, ["store", "i", "j"]).select("store", "i", "j", F.col("n").alias("n_points"), F.col("rms").alias("reproj_rms_px"), F.col("median").alias("reproj_median_px"), "overlap_ncc", "overlap_frac")


def layout_metrics(work: DataFrame, layout: DataFrame, pairs: DataFrame, errors: DataFrame | None = None, agreement: DataFrame | None = None) -> DataFrame:
    """A row per store: pooled rms, median, p95 of residuals; means and least of pairs' ncc and overlap under the layout; nulls and 0 without pairs.

    errors, agreement: as for pair_metrics().
    """
    pooled = residual_metrics(residuals(layout, pairs), ["store"], "err") if errors is None else residual_metrics_of_any_size(errors, ["store"], "err")
    by_pair = pair_scores(layout_agreement(work, layout, pairs) if agreement is None else agreement, ["store"])
    out = work.select("store").distinct().join(pooled, "store", "left").join(by_pair, "store", "left")
    return out.select("store", F.coalesce("n_pairs_scored", F.lit(0)).alias("n_pairs_scored"), F.col("rms").alias("reproj_rms_px"), F.col("median").alias("reproj_median_px"), F.col("p95").alias("reproj_p95_px"), "mean_overlap_ncc", "min_overlap_ncc", "mean_overlap_frac")
