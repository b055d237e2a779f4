"""Receptive fields in long form, rows (key, t, x, y, w): splitting, describing, fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _peak(key: str):
    """Where the largest weight by size is (the first in order of time and place)."""
    return F.min_by(F.struct("t", "x", "y", "w"), F.struct(-F.abs("w"), "t", "x", "y")).alias("p")


def split_sd(rf: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Space: standard deviation over time; time: weights of the pixel where it is largest."""
    srf = rf.groupBy(key, "x", "y").agg(F.stddev_pop("w").alias("w"))
    at = srf.groupBy(key).agg(F.min_by(F.struct("x", "y"), F.struct(-F.col("w"), "x", "y")).alias("p")).select(key, "p.*")
    return srf, rf.join(at, [key, "x", "y"]).select(key, "t", "w")


def split_peak(rf: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Slices through the largest weight."""
    at = rf.groupBy(key).agg(_peak(key)).select(key, F.col("p.t").alias("_t"), F.col("p.x").alias("_x"), F.col("p.y").alias("_y"))
    j = rf.join(at, key)
    return j.where("t = _t").select(key, "x", "y", "w"), j.where("x = _x AND y = _y").select(key, "t", "w")


def merge(srf: DataFrame, trf: DataFrame, key: str) -> DataFrame:
    """Outer product of space and time."""
    return srf.withColumnRenamed("w", "_s").join(trf, key).select(key, "t", "x", "y", (F.col("_s") * F.col("w")).alias("w"))


def normalise(rf: DataFrame, key: str) -> DataFrame:
    """Weights over the summed weight of the sign of the largest one."""
    at = rf.groupBy(key).agg(_peak(key)).select(key, F.signum("p.w").alias("_s"))
    w = Window.partitionBy(key)
    total = F.sum(F.greatest(F.col("_s") * F.col("w"), F.lit(0.0))).over(w)
    return rf.join(at, key).withColumn("w", F.try_divide("w", total)).drop("_s")


def weight_shares(rf: DataFrame, key: str, centre: str) -> DataFrame:
    """Summed centre and surround (the rest) weights over the summed size; ``centre`` is the fitted weight."""
    size = F.sum(F.abs("w"))
    return rf.groupBy(key).agg(F.try_divide(F.sum(centre), size).alias("centre_index"), F.try_divide(F.sum(F.col("w") - F.col(centre)), size).alias("surround_index"))


def split_svd(rf: DataFrame, key: str) -> DataFrame:
    """(key, times, time, shape, space, explained): first of the singular components; the share is of the
    first three. Time has a largest size of 1, space the rest. One key's weights are one filter: lags x pixels."""
    import numpy as np
    import pandas as pd

    from epochal.functions.kernels import rank_one

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="t", columns=["x", "y"], values="w", fill_value=0.0).sort_index()
        v = m.to_numpy()
        t, s, share = rank_one(v)
        scale = float(t @ v @ s)
        top = np.abs(t).max() or 1.0
        xs = [(int(a), int(b)) for a, b in m.columns]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "times": [m.index.to_numpy(float)], "time": [t / top], "xs": [[a for a, _ in xs]], "ys": [[b for _, b in xs]], "space": [s * scale * top], "explained": [share]})

    return rf.groupBy(key).applyInPandas(run, f"{key} long, times array<double>, time array<double>, xs array<int>, ys array<int>, space array<double>, explained double")


def temporal(trf: DataFrame, key: str, nstd: float = 1.0, latest: float = float("inf"), baseline: float = 0.0) -> DataFrame:
    """Polarity, lag of the main peak, transience, width at half amplitude and baseline share of each
    time course (key, t, w)."""
    import pandas as pd

    from epochal.functions.fitting import temporal_features

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("t")
        f = temporal_features(p["t"].to_numpy(float), p["w"].to_numpy(float), nstd, latest, baseline)
        return pd.DataFrame([{key: p[key].iloc[0], **f}])

    return trf.groupBy(key).applyInPandas(run, f"{key} long, polarity int, peak_lag double, transience double, half_width double, baseline_share double")


def _image(pdf):
    import numpy as np

    x0, y0 = int(pdf["x"].min()), int(pdf["y"].min())
    im = np.zeros((int(pdf["x"].max()) - x0 + 1, int(pdf["y"].max()) - y0 + 1))
    im[pdf["x"] - x0, pdf["y"] - y0] = pdf["w"]
    return im, x0, y0


def spatial(srf: DataFrame, key: str, px: float = 1.0, py: float = 1.0, surround: bool = False) -> DataFrame:
    """Gaussian (or centre less surround) fit of each image (key, x, y, w): place, spread, area of the
    ellipse of two deviations, its equivalent diameter, explained variance, centre and surround index."""
    import math

    import numpy as np
    import pandas as pd

    from epochal.functions.fitting import fit_spatial

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        im, x0, y0 = _image(pdf)
        f = fit_spatial(im, surround)
        area = math.pi * 4 * f["x_stddev"] * px * f["y_stddev"] * py
        size = np.abs(im).sum() or 1.0
        c = f["centre"].sum() / size
        row = {key: pdf[key].iloc[0], "polarity": f["polarity"], "cx": f["x_mean"] + x0, "cy": f["y_mean"] + y0, "sx": f["x_stddev"], "sy": f["y_stddev"]}
        return pd.DataFrame([{**row, "area": area, "diameter": 2 * math.sqrt(area / math.pi), "explained": f["explained"], "centre_index": c, "surround_index": im.sum() / size - c}])

    return srf.groupBy(key).applyInPandas(run, f"{key} long, polarity int, cx double, cy double, sx double, sy double, area double, diameter double, explained double, centre_index double, surround_index double")


def outlines(srf: DataFrame, key: str, levels: list[float], blur: float = 0.0, inner: float = 0.0, outer: float = 2.0) -> DataFrame:
    """Largest closed contour at each level of the blurred image scaled by its largest size: area, centre,
    irregularity (1 less area over hull area; 1 without a contour), pixels inside and in the
    ring between ``inner`` and ``outer`` pixels from it."""
    import numpy as np
    import pandas as pd

    from epochal.functions import fitting, kernels

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        im, x0, y0 = _image(pdf)
        im = fitting.smooth(im, blur)
        im = im / (np.abs(im).max() or 1.0)
        rows = []
        for level in levels:
            found = fitting.contours(im, level)
            row = {key: pdf[key].iloc[0], "level": level, "n": len(found), "area": 0.0, "cx": None, "cy": None, "irregular": 1.0, "inside": 0, "ring": 0}
            if found:
                p = max(found, key=lambda q: kernels.polygon_area(q[:, 0], q[:, 1]))
                area, hull = kernels.polygon_area(p[:, 0], p[:, 1]), kernels.hull_area(p)
                if area > 0:
                    cx, cy = fitting.polygon_centre(p)
                    mask = fitting.inside(p, im.shape)
                    row.update(area=area, cx=cx + x0, cy=cy + y0, irregular=1 - area / hull, inside=int(mask.sum()), ring=int((fitting.dilate(mask, outer) & ~fitting.dilate(mask, inner)).sum()))
            rows.append(row)
        return pd.DataFrame(rows)

    return srf.groupBy(key).applyInPandas(run, f"{key} long, level double, n int, area double, cx double, cy double, irregular double, inside int, ring int")


def outline_lines(srf: DataFrame, key: str, levels: list[float], scale: bool = True) -> DataFrame:
    """(key, level, line, closed, length, area, points): all lines of equal value of each image (key, x, y, w), open ones too, the longest first;
    levels are parts of the largest size unless ``scale`` is false.  An open line has no area."""
    import numpy as np
    import pandas as pd

    from epochal.functions import fitting, kernels

    kind = srf.schema[key].dataType.simpleString()

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["x"].min()), int(pdf["y"].min())
        im = np.zeros((int(pdf["x"].max()) - x0 + 1, int(pdf["y"].max()) - y0 + 1))
        im[pdf["x"] - x0, pdf["y"] - y0] = pdf["w"]
        im = im / (np.abs(im).max() or 1.0) if scale else im
        rows = []
        for level in levels:
            found = []
            for p, closed in fitting.contour_lines(im, level):
                q = np.vstack((p, p[:1])) if closed else p
                found.append((float(np.linalg.norm(np.diff(q, axis=0), axis=1).sum()), closed, p))
            for n, (length, closed, p) in enumerate(sorted(found, key=lambda f: (-f[0], f[2].tolist()))):
                area = float(kernels.polygon_area(p[:, 0], p[:, 1])) if closed else None
                rows.append((k[0], level, n, closed, length, area, (p + [x0, y0]).tolist()))
        return pd.DataFrame(rows, columns=[key, "level", "line", "closed", "length", "area", "points"])

    return srf.groupBy(key).applyInPandas(run, f"`{key}` {kind}, level double, line int, closed boolean, length double, area double, points array<array<double>>")


def _fitted(samples: DataFrame, key: str, stimulus: str, response: str, fit, schema: str, width: int) -> DataFrame:
    """Rows of ``fit``, which takes the keys of one length at a time: a stack of stimuli and one of responses (keys by samples), and gives for each column a
    value a key, or None for no rows.  A stack has about 2^20 / ``width`` samples, a longer key its own."""
    import numpy as np
    import pyarrow as pa

    from epochal.functions.shared import rows_of

    def run(batches):
        for b in batches:
            n = pa.compute.list_value_length(b.column(1)).to_numpy()
            for length in np.unique(n):
                which, most = np.flatnonzero(n == length), max(1, (1 << 20) // (int(length) * width))
                for low in range(0, len(which), most):
                    part = b.take(pa.array(which[low : low + most]))
                    found = fit(rows_of(part.column(1)), rows_of(part.column(2)))
                    if found is not None:
                        yield pa.RecordBatch.from_arrays([part.column(0), *found], names)

    values = F.sort_array(F.collect_list(F.struct("i", F.col(stimulus).cast("double").alias("s"), F.col(response).cast("double").alias("r"))))
    rows = samples.groupBy(key).agg(values.alias("_a")).select(key, F.col("_a.s").alias("s"), F.col("_a.r").alias("r"))
    kind = samples.schema[key].dataType.simpleString()
    names = [key, *(c.strip().split()[0] for c in schema.split(","))]
    return rows.mapInArrow(run, f"`{key}` {kind}, {schema}")


def spline_filter(samples: DataFrame, key: str, stimulus: str, response: str, lags: int, dfs: list[int], betas: list[float], test: float = 0.2, dev: float = 0.2, shuffles: int = 20, seed: int = 42) -> DataFrame:
    """Filter as a sum of splines, one row a key: (df, beta, filter, cc_dev, cc_test, mse_test, p_value).

    Contiguous parts: the last ``test`` share, before it ``dev`` of the rest, a gap of ``lags`` samples
    between them. Every df and beta is fitted with an L1 penalty and early stopping; the best correlation on
    the development part wins. ``p_value``: share of shuffled lag orders whose test correlation is at least as high."""
    import numpy as np
    import pyarrow as pa

    from epochal.functions.fitting import bspline_basis, correlations, lagged, lasso_paths, times

    def fit(stim: np.ndarray, y: np.ndarray) -> list:
        keys, n = y.shape
        x = lagged(stim, lags)
        b = int(n * (1 - test))
        a = int(b * (1 - dev))
        if a:
            sd = y[:, :a].std(1, keepdims=True)
            y = (y - y[:, :a].mean(1, keepdims=True)) / np.where(sd == 0, 1.0, sd)
            x = x - x[:, :a].mean(1, keepdims=True)
        d, t = slice(min(a + lags, b), b), slice(min(b + lags, n), n)
        score = None
        again = lambda v: np.concatenate([v] * len(betas))
        for f in dfs:
            basis = bspline_basis(lags, min(f, lags))
            found = lasso_paths(again(x[:, :a] @ basis), again(y[:, :a]), np.repeat(betas, keys), again(x[:, d] @ basis), again(y[:, d]))
            for k, penalty in enumerate(betas):
                v = times(basis, found[k * keys : (k + 1) * keys])
                new = correlations(times(x[:, d], v), y[:, d])
                if score is None:
                    score, df, beta, w = new, np.full(keys, f), np.full(keys, penalty, float), v
                    continue
                better = new > score + 1e-12
                score, df, beta, w = np.where(better, new, score), np.where(better, f, df), np.where(better, penalty, beta), np.where(better[:, None], v, w)
        guess = times(x[:, t], w)
        true = correlations(guess, y[:, t])
        rng = np.random.default_rng(seed)
        orders = np.array([rng.permutation(lags) for _ in range(shuffles)], int).reshape(shuffles, lags)
        null = times(x[:, None, t], w[:, orders]).reshape(keys * shuffles, t.stop - t.start)
        high = correlations(null, np.repeat(y[:, t], shuffles, 0)).reshape(keys, shuffles) >= true[:, None]
        mse = np.mean((guess - y[:, t]) ** 2, 1) if n > b + lags else np.full(keys, np.nan)
        doubles = [pa.array(v, pa.float64(), from_pandas=True) for v in (score, true, mse, high.mean(1) if shuffles else np.full(keys, np.nan))]
        return [pa.array(df, pa.int32()), pa.array(beta, pa.float64()), pa.array(list(w), pa.list_(pa.float64())), *doubles]

    return _fitted(samples.withColumn(key, F.col(key).cast("long")), key, stimulus, response, fit, "df int, beta double, filter array<double>, cc_dev double, cc_test double, mse_test double, p_value double", lags + shuffles)


def response_model(samples: DataFrame, key: str, stimulus: str, response: str, lags: int, dfs: list[int], betas: list[float], loss: str = "poisson", output: str = "softplus", test: float = 0.2, dev: float = 0.2) -> DataFrame:
    """Spline filter of a generalised linear model, one row a key: (df, beta, filter, intercept, dev_loss, test_loss, null_loss, cc_test).

    ``loss``: ``poisson`` (counts) or ``gaussian``; ``output``, applied to the filtered stimulus: ``softplus``, ``exponential`` or ``none``.  Parts as in
    :func:`spline_filter`.  For every number of splines the penalties are gone through from the largest, each starting
    from the one before; the least loss on the development part wins.  ``null_loss``: of the training part's mean, on the test part."""
    import numpy as np
    import pyarrow as pa

    from epochal.functions.fitting import OUTPUTS, bspline_basis, correlations, deviances, lagged, penalised_paths, times

    if loss not in ("poisson", "gaussian") or output not in OUTPUTS or (loss == "poisson" and output == "none"):
        raise ValueError("loss is poisson or gaussian; output softplus, exponential or (gaussian only) none")
    link = OUTPUTS[output][0]

    def run(stim: np.ndarray, y: np.ndarray) -> list | None:
        keys, n = y.shape
        x = lagged(stim, lags)
        b = int(n * (1 - test))
        a = int(b * (1 - dev))
        d, t = slice(min(a + lags, b), b), slice(min(b + lags, n), n)
        if not a or d.start == d.stop or t.start == t.stop:
            return None
        score = None
        for f in dfs:
            basis = bspline_basis(lags, min(f, lags))
            for penalty, (v, const) in penalised_paths(x[:, :a] @ basis, y[:, :a], betas, loss, output).items():
                v = times(basis, v)
                new = deviances(y[:, d], link(times(x[:, d], v) + const[:, None]), loss)
                if score is None:
                    score, df, beta, w, c = new, np.full(keys, f), np.full(keys, penalty, float), v, const
                    continue
                better = new < score - 1e-12
                score, df, beta, c = (np.where(better, p, q) for p, q in ((new, score), (f, df), (penalty, beta), (const, c)))
                w = np.where(better[:, None], v, w)
        fit = link(times(x[:, t], w) + c[:, None])
        null = deviances(y[:, t], np.repeat(np.maximum(y[:, :a].mean(1), 1e-12)[:, None], t.stop - t.start, 1), loss)
        doubles = [pa.array(v, pa.float64(), from_pandas=True) for v in (c, score, deviances(y[:, t], fit, loss), null, correlations(fit, y[:, t]))]
        return [pa.array(df, pa.int32()), pa.array(beta, pa.float64()), pa.array(list(w), pa.list_(pa.float64())), *doubles]

    return _fitted(samples, key, stimulus, response, run, "df int, beta double, filter array<double>, intercept double, dev_loss double, test_loss double, null_loss double, cc_test double", lags)


def offset(centres: DataFrame, width: int, height: int, px: float, py: float, stim_x: float = 0.0, stim_y: float = 0.0) -> DataFrame:
    """Micrometres of a fitted centre (cx, cy in pixels, a pixel's middle at + 0.5) from the middle of the
    screen, with the stimulus' own offset."""
    return centres.withColumns({"dx_um": (F.col("cx") + 0.5 - width / 2) * px + stim_x, "dy_um": (F.col("cy") + 0.5 - height / 2) * py + stim_y})


def contrast_fit(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Saturating fit of responses by contrast, replaced by a line where its error is over 1.05 of the line's:
    (kind, half_x, half_y, half_slope, mse)."""
    import numpy as np
    import pandas as pd

    from epochal.functions import fitting

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, r = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        slope, base = np.polyfit(s, r, 1) if np.ptp(s) > 0 else (0.0, r.mean())
        line = float(np.mean((r - slope * s - base) ** 2))
        p, mse = fitting.fit_naka_rushton(s, r)
        if np.isfinite(mse) and mse <= 1.05 * line:
            b, top, half, n = p
            row = ("saturating", half, b + top / 2, top * n / (4 * half), mse)
        else:
            row = ("linear", (s.min() + s.max()) / 2, base + slope * (s.min() + s.max()) / 2, slope, line)
        return pd.DataFrame([(pdf[key].iloc[0], *row)], columns=[key, "kind", "half_x", "half_y", "half_slope", "mse"])

    return points.groupBy(key).applyInPandas(run, f"{key} long, kind string, half_x double, half_y double, half_slope double, mse double")
