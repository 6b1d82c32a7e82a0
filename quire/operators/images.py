"""Image kernels over struct(h, w, data: array<double>): Arrow batches of numpy arrays, one image at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

IMAGE = "struct<h:int,w:int,data:array<double>>"
# Fixed values of the kernels.
LEAST_WIDTH, LEAST_HEIGHT, MOST_VARIANTS = 1200, 1600, 4
SAUVOLA_WINDOW, SAUVOLA_K, SAUVOLA_R, SKEW_ANGLES, SKEW_LEAST = 25, 0.2, 255.0, range(-10, 11), 0.5
DARK_BELOW, BINS, MOST_HEIGHT, MOST_WIDTH, TEMPLATE_WEIGHT, SIMILAR_FROM, MOST_REFERENCES, MOST_FEATURES = 127, 64, 100, 200, 0.7, 0.85, 5, 50
#: Pixels of variants that are handed on at a time.
HELD = 1 << 22


# --- numpy kernels ---


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(x))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Filters and how far they reach.
FILTERS = {"bilinear": (triangle, 1.0), "lanczos": (lanczos, 3.0)}


def resampling(n: int, m: int, kind: str) -> np.ndarray:
    """n x m weights that make n pixels of m: the filter about each new pixel's centre, wider by the scale where pixels get fewer."""
    kernel, reach = FILTERS[kind]
    scale = m / n
    wide = max(scale, 1.0)
    centre = (np.arange(n)[:, None] + 0.5) * scale
    at = np.arange(m)[None]
    first, last = np.floor(np.maximum(0, centre - reach * wide + 0.5)), np.floor(np.minimum(m, centre + reach * wide + 0.5))
    weights = np.where((at >= first) & (at < last), kernel((at + 0.5 - centre) / wide), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(x: np.ndarray, h: int, w: int, kind: str = "bilinear") -> np.ndarray:
    """Whole gray values: columns first, then rows, each rounded into 0..255; values are cut to whole ones before."""
    x = np.trunc(x)
    whole = lambda y: np.clip(np.floor(y + 0.5), 0, 255)
    x = x if w == x.shape[1] else whole(x @ resampling(w, x.shape[1], kind).T)
    return x if h == x.shape[0] else whole(resampling(h, x.shape[0], kind) @ x)


def clean(x: np.ndarray) -> np.ndarray:
    """Twice as large if it is small both ways."""
    return resize(x, 2 * x.shape[0], 2 * x.shape[1], "lanczos") if x.shape[1] < LEAST_WIDTH and x.shape[0] < LEAST_HEIGHT else x


def denoise(x: np.ndarray) -> np.ndarray:
    """Median of 3 x 3."""
    p = np.pad(x, 1, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (3, 3)).reshape(*x.shape, 9), axis=2)


def sauvola(x: np.ndarray) -> np.ndarray:
    """Black where a pixel is under m (1 + k (s / R - 1)) of its window."""
    p = np.pad(x.astype(np.float64), SAUVOLA_WINDOW // 2, mode="reflect" if min(x.shape) > SAUVOLA_WINDOW // 2 else "edge")

    def mean(y: np.ndarray) -> np.ndarray:
        s = np.pad(y.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        n = SAUVOLA_WINDOW
        return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / n**2

    m = mean(p)
    s = np.sqrt(np.maximum(mean(p * p) - m * m, 0))
    return np.where(x > m * (1 + SAUVOLA_K * (s / SAUVOLA_R - 1)), 255.0, 0.0)


def rotate(x: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise about the centre, bilinear, black outside."""
    h, w = x.shape
    a, (r, c) = np.deg2rad(degrees), np.mgrid[:h, :w]
    r, c = r - (h / 2 - 0.5), c - (w / 2 - 0.5)
    y, z = np.sin(a) * c + np.cos(a) * r + (h / 2 - 0.5), np.cos(a) * c - np.sin(a) * r + (w / 2 - 0.5)
    y0, z0 = np.floor(y).astype(int), np.floor(z).astype(int)
    fy, fz = y - y0, z - z0
    p = np.pad(x.astype(np.float64), 1)
    at = lambda i, j: p[np.clip(i, -1, h) + 1, np.clip(j, -1, w) + 1]
    return (at(y0, z0) * (1 - fz) + at(y0, z0 + 1) * fz) * (1 - fy) + (at(y0 + 1, z0) * (1 - fz) + at(y0 + 1, z0 + 1) * fz) * fy


def skew(x: np.ndarray) -> int:
    """The whole angle that makes rows differ most; the first of equals."""
    best, found = -1.0, 0
    for angle in SKEW_ANGLES:
        v = float(rotate(x, angle).mean(axis=1).var())
        if v > best:
            best, found = v, angle
    return found


def deskew(x: np.ndarray) -> np.ndarray | None:
    """The image upright, in whole gray values; none where it is so already."""
    angle = skew(x)
    return np.trunc(rotate(x, angle)) if abs(angle) >= SKEW_LEAST else None


STEPS = {"clean": clean, "denoise": denoise, "sauvola": sauvola, "deskew": deskew}


def edges(x: np.ndarray) -> np.ndarray:
    """Eight times a pixel less its neighbours, plus nothing at the border."""
    if min(x.shape) < 3:
        return np.zeros((1, 1))
    near = np.lib.stride_tricks.sliding_window_view(x, (3, 3)).sum(axis=(2, 3))
    return np.clip(9 * x[1:-1, 1:-1] - near, 0, 255)


def features(x: np.ndarray) -> tuple[float, float, float, float]:
    """Brightness, contrast, sharpness, share of dark pixels."""
    return float(x.mean()), float(x.std()), float(edges(x).var()), float((x < DARK_BELOW).mean())


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised cross-correlation of two arrays of one size; 0 if either is constant."""
    a, b = a.ravel() - a.mean(), b.ravel() - b.mean()
    n = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / n) if n > 0 else 0.0


def histogram(x: np.ndarray) -> np.ndarray:
    return np.histogram(x, BINS, (0, 255))[0].astype(np.float64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Template and histogram correlation, blended, of both images at the lesser height and width, MOST_HEIGHT x MOST_WIDTH at most."""
    size = min(a.shape[0], b.shape[0], MOST_HEIGHT), min(a.shape[1], b.shape[1], MOST_WIDTH)
    a, b = resize(a, *size), resize(b, *size)
    return TEMPLATE_WEIGHT * correlation(a, b) + (1 - TEMPLATE_WEIGHT) * correlation(histogram(a), histogram(b))


# --- over columns ---


def _array(image: dict | None) -> np.ndarray | None:
    if image is None or image["data"] is None or not image["h"] or not image["w"] or len(image["data"]) != image["h"] * image["w"]:
        return None
    return np.asarray(image["data"], np.float64).reshape(image["h"], image["w"])


def _images(column) -> list[np.ndarray | None]:
    rows = column.to_dict("records") if isinstance(column, pd.DataFrame) else column
    return [_array(r) for r in rows]


def image_features(df: DataFrame, image_col: str = "image") -> DataFrame:
    """df with brightness, contrast, sharpness, density in place of the image; nulls where it can't be decoded."""

    @F.pandas_udf("brightness double, contrast double, sharpness double, density double")
    def of(image: pd.DataFrame) -> pd.DataFrame:
        rows = [(None,) * 4 if x is None else features(x) for x in _images(image)]
        return pd.DataFrame(rows, columns=["brightness", "contrast", "sharpness", "density"], dtype="float64")

    return df.withColumn("__f", of(image_col)).drop(image_col).select("*", "__f.*").drop("__f")


def field_features(files: DataFrame, image_col: str = "image") -> DataFrame:
    """field, outcome and mean features over the first MOST_FEATURES decodable files by name."""
    from pyspark.sql import Window

    ok = files.filter(F.col(image_col).isNotNull())
    first = ok.withColumn("__n", F.row_number().over(Window.partitionBy("field", "outcome").orderBy("filename"))).filter(F.col("__n") <= MOST_FEATURES).drop("__n")
    names = ("brightness", "contrast", "sharpness", "density")
    return image_features(first, image_col).groupBy("field", "outcome").agg(*[F.avg(n).alias(n) for n in names])


def variants(df: DataFrame, steps: tuple[str, ...] = ("denoise", "sauvola", "deskew"), image_col: str = "image", most: int = MOST_VARIANTS) -> DataFrame:
    """A row for each variant, `most` at most: clean first, then the steps on the original; an image that can't be decoded has none, and a step may have none."""
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, pixels = [], 0
        for b in batches:
            for row in b.to_dict("records"):
                if (x := _array(row[image_col])) is None:
                    continue
                found = 0
                for name in ("clean", *steps):
                    if found >= most or (y := STEPS[name](x)) is None:
                        continue
                    rows.append(row | {image_col: {"h": y.shape[0], "w": y.shape[1], "data": y.ravel()}, "variant": name, "position": found})
                    found += 1
                    pixels += y.size
                if pixels > HELD:
                    yield pd.DataFrame(rows, columns=[*columns, "variant", "position"])
                    rows, pixels = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=[*columns, "variant", "position"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, variant string, position int")


def visual_similarity(a: Column, b: Column) -> Column:
    """Similarity of two image columns; 0 where either can't be decoded."""

    @F.pandas_udf(DoubleType())
    def of(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        return pd.Series([0.0 if p is None or q is None else similarity(p, q) for p, q in zip(_images(x), _images(y), strict=True)])

    return of(a, b)


def histogram_correlation(values: DataFrame, key: list[str], a: str, b: str, low: float = 0.0, high: float = 255.0, bins: int = BINS) -> DataFrame:
    """Key and correlation of the histograms of two array columns, in SQL functions alone."""
    width = (high - low) / bins
    # both histograms by one pass over the values, rather than a scan for each bin
    place = lambda v: F.least(F.floor((v.cast("double") - low) / width).cast("int"), F.lit(bins - 1))
    inside = lambda c: F.filter(F.col(c), lambda v: (v >= low) & (v <= high))
    long = values.select(*key, F.explode(F.concat(F.transform(inside(a), lambda v: F.struct(F.lit(1).alias("a"), place(v).alias("bin"))), F.transform(inside(b), lambda v: F.struct(F.lit(0).alias("a"), place(v).alias("bin"))))).alias("x"))
    counts = long.groupBy(*key, "x.bin").agg(F.sum("x.a").alias("x"), F.sum(1 - F.col("x.a")).alias("y"))
    # bins that neither holds count as pairs of zeros
    x, y, n = F.col("x").cast("double"), F.col("y").cast("double"), F.lit(float(bins))
    s = counts.groupBy(*key).agg(F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    top = n * F.col("sxy") - F.col("sx") * F.col("sy")
    below = F.sqrt((n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy")))
    return s.select(*key, F.coalesce(top / F.nullif(below, F.lit(0.0)), F.lit(0.0)).alias("correlation"))


def array_correlation(a: Column, b: Column) -> Column:
    """Normalised cross-correlation of two arrays of one length; 0 if either is constant."""
    total = lambda c: F.aggregate(F.transform(c, lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.size(a).cast("double")
    sx, sy = total(a), total(b)
    sxy = total(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")))
    sxx, syy = (total(F.transform(c, lambda v: v.cast("double") * v.cast("double"))) for c in (a, b))
    below = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return F.coalesce((n * sxy - sx * sy) / F.nullif(below, F.lit(0.0)), F.lit(0.0))


def reference_matches(targets: DataFrame, refs: DataFrame, similarity_of=visual_similarity, thresholds: DataFrame | None = None, key: tuple[str, ...] = ("field", "expected")) -> DataFrame:
    """field, expected and the rest of the key, mean similarity over up to MOST_REFERENCES references by name, and whether it reaches the field's threshold.

    A reference counts if its number is the expected one or can't be read; similarity_of takes the two image columns. `key` tells targets from each other."""
    from pyspark.sql import Window

    named = refs.select("field", F.col("filename").alias("__name"), F.col("image").alias("__image"), F.regexp_extract("filename", r"\A(\d+)", 1).alias("__number"))
    few = named.withColumn("__n", F.row_number().over(Window.partitionBy("field", "__number").orderBy("__name"))).filter(F.col("__n") <= MOST_REFERENCES).drop("__n")
    by_number = targets.join(few.filter("__number <> ''"), (targets["field"] == few["field"]) & (targets["expected"] == F.col("__number"))).drop(few["field"])
    free = few.filter("__number = ''")
    unnamed = targets.join(free, targets["field"] == free["field"]).drop(free["field"])
    by = list(dict.fromkeys(("field", "expected", *key)))
    both = by_number.unionByName(unnamed).withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__name"))).filter(F.col("__n") <= MOST_REFERENCES)
    found = both.withColumn("__s", similarity_of(F.col("image"), F.col("__image"))).groupBy(*by).agg(F.avg("__s").alias("similarity"), F.count("*").alias("n"))
    if thresholds is not None:
        found = found.join(thresholds, "field", "left")
        return found.withColumn("matches", F.col("similarity") >= F.coalesce("threshold", F.lit(SIMILAR_FROM))).drop("threshold")
    return found.withColumn("matches", F.col("similarity") >= SIMILAR_FROM)
