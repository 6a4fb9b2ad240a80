"""Image rejection: pixel rules D1 to D3, text rules D4 to D6, the fast-then-slow cascade, and its run over URLs.

Pixels are BGR or RGB bytes in rows; the rules on them are Arrow UDFs in numpy. The rules on recognised text are
expressions over ``array<struct<bbox: array<array<float>>, text: string, confidence: float>>``. Text recognition itself is
a plug-in: no model weights ship with this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.pixels import BadImage, decode_bounded
from lonja.functions.text import as_col, trim_space
from lonja.operators.cells import pending
from lonja.sources.fetch import FetchOptions, fetched
from lonja.sources.verdicts import append_verdicts, load_verdicts, next_batch

# Thresholds, motives and word lists of the rules are fixed values.
BAND, BAND_ROWS, BAND_SATURATION, BAND_SHARE = 0.15, 10, 60, 0.55
CORNER, CORNER_SIDE, DARK, SATURATED, CORNER_SHARE = 0.06, 20, 130, 30, 0.18
CANNY_LOW, CANNY_HIGH, EDGE_SHARE, LINES, VOTES, RADIUS = 50.0, 150.0, 0.18, 12, 60, 8
COMMERCIAL = (
    "free", "shipping", "warranty", "guarantee", "sale", "discount", "stock", "delivery", "offer", "quality", "new",
    "brand", "seller", "envío", "garantía", "gratis", "oferta", "nuevo", "venta", "calidad", "worry", "returns",
    "satisfaction", "postal", "service", "fast", "2pcs", "3pcs", "4pcs", "pcs", "kit", "set", "pack", "combo", "hot",
    "best", "buy", "shop", "store", "parts", "auto", "coming soon", "thank you", "business", "appreciate", "reliable",
    "aftermarket", "diagram", "assembly", "exploded", "view", "package list",
)
PLACEHOLDERS = (
    "coming soon", "image coming", "no image", "not available", "photo coming", "image not available", "no photo",
    "awaiting image", "sin imagen", "imagen no disponible", "proximamente", "próximamente", "foto no disponible",
    "no disponible",
)
PART_NUMBERS = (r"(?iu)^[0-9]{1,12}\z", r"(?iu)^[A-Z]{1,4}-?[0-9]{1,6}\z", r"(?iu)^[A-Z]{1,3}[0-9]{1,4}[A-Z]?\z")


@dataclass(frozen=True)
class TextRules:
    confidence: float = 0.40
    length: int = 3
    corner: float = 0.22
    saturation: float = 25.0
    reasons: int = 5
    commercial: Sequence[str] = field(default=COMMERCIAL)
    placeholders: Sequence[str] = field(default=PLACEHOLDERS)


def _saturations() -> np.ndarray:
    """8-bit saturation at 256 times the greatest plus the least channel value."""
    high, low = np.arange(256.0)[:, None], np.arange(256.0)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(high > 0, np.floor(255 * (high - np.minimum(low, high)) / high + 0.5), 0)
    return s.astype(np.uint8).ravel()


_SATURATION = _saturations()


def saturation_value(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit saturation and value of an ``h x w x 3`` image."""
    red, green, blue = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    high, low = np.maximum(np.maximum(red, green), blue), np.minimum(np.minimum(red, green), blue)
    return _SATURATION.take((high.astype(np.intp) << 8) | low), high


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def banner(rgb: np.ndarray) -> str | None:
    """D1: a saturated band at the top or the bottom."""
    rows = min(max(int(np.float32(len(rgb)) * np.float32(BAND)), BAND_ROWS), len(rgb))
    for name, pixels in (("superior", rgb[:rows]), ("inferior", rgb[len(rgb) - rows :])):
        band, _ = saturation_value(pixels)
        share = np.count_nonzero(band > BAND_SATURATION) / band.size if band.size else 0.0
        if share >= BAND_SHARE:
            return f"D1·Banner de color en zona {name} ({share * 100:.0f}% píxeles saturados)"
    return None


def background(rgb: np.ndarray) -> str | None:
    """D2: dark or coloured corners."""
    h, w = rgb.shape[:2]
    side = min(max(int(np.float32(min(h, w)) * np.float32(CORNER)), CORNER_SIDE), min(h, w))
    if not side:
        return None
    spots = [rgb[:side, :side], rgb[:side, w - side :], rgb[h - side :, :side], rgb[h - side :, w - side :]]
    ss, vv = saturation_value(np.stack(spots))
    share = np.count_nonzero((vv < DARK) | (ss > SATURATED)) / vv.size
    if share > CORNER_SHARE:
        return f"D2·Fondo no neutro: {share * 100:.1f}% píxeles no neutros en esquinas (V_media={vv.mean():.0f}, S_media={ss.mean():.0f})"
    return None


def _filter3(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    half = len(kernel) // 2
    padded = np.pad(a, half, mode="edge")
    return np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(padded, kernel.shape), kernel)


def _gradient(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Horizontal and vertical Sobel gradients of the blurred image."""
    t = np.arange(-3, 4)
    bell = np.exp(-(t**2) / (2 * 1.4**2))
    smooth = _filter3(gray.astype(np.float64), np.outer(bell, bell) / bell.sum() ** 2)
    sobel = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
    return _filter3(smooth, sobel), _filter3(smooth, sobel.T)


def _thinned(gx: np.ndarray, gy: np.ndarray, size: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edge mask of gradients of this size: thinning along the gradient, hysteresis."""
    turn = (np.round(np.degrees(np.arctan2(gy, gx)) / 45).astype(int)) % 4
    padded = np.pad(size, 1)
    h, w = size.shape

    def shifted(dy: int, dx: int) -> np.ndarray:
        return padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    peak = np.zeros_like(size, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        peak |= (turn == k) & (size >= shifted(dy, dx)) & (size >= shifted(-dy, -dx))
    weak, strong = peak & (size > low), peak & (size > high)
    while True:
        around = np.lib.stride_tricks.sliding_window_view(np.pad(strong, 1), (3, 3)).any(axis=(2, 3))
        grown = weak & around | strong
        if (grown == strong).all():
            return strong
        strong = grown


def canny(gray: np.ndarray, low: float = CANNY_LOW, high: float = CANNY_HIGH) -> np.ndarray:
    """Edge mask: blur, Sobel gradients, thinning along the gradient, hysteresis."""
    gx, gy = _gradient(gray)
    return _thinned(gx, gy, np.hypot(gx, gy), low, high)


def straight_lines(edges: np.ndarray, votes: int = VOTES, radius: int = RADIUS) -> int:
    """Peaks of the Hough accumulator with a vote threshold and a suppression radius."""
    ys, xs = np.nonzero(edges)
    if not len(ys):
        return 0
    angles = np.radians(np.arange(180))
    reach = int(np.ceil(np.hypot(*edges.shape)))
    table = np.zeros((2 * reach + 1, 180), np.int64)
    for k, (c, s) in enumerate(zip(np.cos(angles), np.sin(angles), strict=True)):
        table[:, k] = np.bincount(np.round(xs * c + ys * s).astype(int) + reach, minlength=2 * reach + 1)
    wide = np.pad(table, radius)
    best = np.lib.stride_tricks.sliding_window_view(wide, (2 * radius + 1,) * 2).max(axis=(2, 3))
    return int(((table >= votes) & (table == best)).sum())


def diagram(rgb: np.ndarray) -> str | None:
    """D3: many edges and many straight lines.

    The later steps only take pixels away, so an image goes through them only while it may still have edges enough. A
    gradient is at most ``4 * sqrt(2)`` times the range of the luma, as the blur's weights sum to 1.
    """
    gray = luma(rgb)
    if not gray.size or 6 * (gray.max() - gray.min()) <= CANNY_LOW:
        return None
    gx, gy = _gradient(gray)
    size = np.hypot(gx, gy)
    if (size > CANNY_LOW).mean() <= EDGE_SHARE:
        return None
    edges = _thinned(gx, gy, size, CANNY_LOW, CANNY_HIGH)
    share = float(edges.mean())
    if share <= EDGE_SHARE:
        return None
    lines = straight_lines(edges)
    return f"D3·Diagrama técnico: ratio_bordes={share:.3f}, líneas_rectas={lines}" if lines >= LINES else None


PIXEL_RULES: dict[str, Callable[[np.ndarray], str | None]] = {"d1": banner, "d2": background, "d3": diagram}


def first_reason(image: np.ndarray, rules: Sequence[str] = ("d1", "d2", "d3")) -> str | None:
    return next((reason for r in rules if (reason := PIXEL_RULES[r](image)) is not None), None)


def pixel_reason(height: Column, width: Column, rgb: Column, rules: Sequence[str] = ("d1", "d2", "d3")) -> Column:
    """Reason of the first pixel rule that rejects, null if none does. A broken image has the reason of its error."""

    @F.pandas_udf("string")
    def judge(h: pd.Series, w: pd.Series, data: pd.Series) -> pd.Series:
        def one(rows: int, columns: int, raw: bytes) -> str | None:
            try:
                image = np.frombuffer(raw, np.uint8).reshape(int(rows), int(columns), 3)
            except (TypeError, ValueError) as error:
                return f"Imagen ilegible: {error}"
            return first_reason(image, rules)

        return pd.Series([one(*x) for x in zip(h, w, data, strict=True)], dtype=object)

    return judge(height, width, rgb)


def decoded(content: Column, longest: int | None = 1280) -> Column:
    """``struct<height, width, rgb>`` of a file's bytes, longest side bounded; null fields where they are no image."""

    @F.pandas_udf("height int, width int, rgb binary")
    def run(data: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in data:
            try:
                image = decode_bounded(raw, longest) if raw is not None else None
            except BadImage:
                image = None
            rows.append((None, None, None) if image is None else (*image.shape[:2], image.tobytes()))
        return pd.DataFrame(rows, columns=["height", "width", "rgb"], dtype=object)

    return run(content)


def bgr_to_rgb(data: Column) -> Column:
    """Bytes of the image source in red, green, blue order."""

    @F.pandas_udf("binary")
    def swap(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: np.frombuffer(b, np.uint8).reshape(-1, 3)[:, ::-1].tobytes(), na_action="ignore")

    return swap(data)


def valid_fragments(fragments: Column | str, rules: TextRules = TextRules()) -> Column:
    """Fragments of enough confidence and length, texts trimmed."""
    trimmed = F.transform(as_col(fragments), lambda r: r.withField("text", trim_space(r["text"])))
    return F.filter(trimmed, lambda r: (r["confidence"] >= rules.confidence) & (F.char_length(r["text"]) >= rules.length))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def placeholder_reason(valid: Column, rules: TextRules = TextRules()) -> Column:
    """D6: all words of a placeholder phrase stand somewhere in the image."""
    words = F.flatten(F.transform(valid, lambda r: _words(r["text"])))
    found = F.lit(None).cast("string")
    for phrase in reversed(rules.placeholders):
        inside = F.forall(F.array(*[F.lit(w) for w in phrase.split()]), lambda w: F.array_contains(words, w))
        found = F.when(inside, F.lit(f"D6·Imagen placeholder: contiene '{phrase}'")).otherwise(found)
    return found


def phrase_reason(valid: Column, rules: TextRules = TextRules()) -> Column:
    """D4 for phrases: a commercial phrase in the joined text."""
    joined = F.array_join(F.transform(valid, lambda r: F.lower(r["text"])), " ")
    found = F.lit(None).cast("string")
    for phrase in reversed([w for w in rules.commercial if " " in w]):
        found = F.when(F.contains(joined, F.lit(phrase)), F.lit(f"D4·Texto comercial (frase): '{phrase}'")).otherwise(found)
    return found


def _in_corner(r: Column, height: Column, width: Column, share: float) -> Column:
    x = F.aggregate(r["bbox"], F.lit(0.0), lambda a, p: a + p[0]) / 4
    y = F.aggregate(r["bbox"], F.lit(0.0), lambda a, p: a + p[1]) / 4
    radius = F.least(width, height) * share
    dx, dy = F.least(F.abs(x), F.abs(x - width)), F.least(F.abs(y), F.abs(y - height))
    return dx * dx + dy * dy <= radius * radius


def fragment_reasons(valid: Column, height: Column, width: Column, rules: TextRules = TextRules()) -> Column:
    """D4 for words, D5 for coloured text in a corner: one reason a fragment, none for what looks like a part number.

    A fragment may carry ``saturation``, the mean over its box, which ``with_saturation`` adds; D5 needs it.
    """
    single = F.array(*[F.lit(w) for w in rules.commercial if " " not in w])

    def reason(r: Column) -> Column:
        number = F.lit(False)
        for pattern in PART_NUMBERS:
            number = number | r["text"].rlike(pattern)
        hits = F.array_intersect(F.array_distinct(_words(r["text"])), single)
        sure = F.format_number(r["confidence"], 2)
        coloured = F.coalesce(r["saturation"] > rules.saturation, F.lit(False)) & _in_corner(r, height, width, rules.corner)
        word = F.concat(F.lit("D4·Texto comercial: '"), r["text"], F.lit("' (palabras: "), F.array_join(hits, ", "), F.lit(", conf="), sure, F.lit(")"))
        logo = F.concat(F.lit("D5·Logo/texto en esquina: '"), r["text"], F.lit("' (conf="), sure, F.lit(")"))
        return F.when(number, F.lit(None)).when(F.size(hits) > 0, word).when(coloured, logo)

    return F.filter(F.transform(valid, reason), lambda x: x.isNotNull())


def text_reason(fragments: Column | str, height: Column, width: Column, rules: TextRules = TextRules()) -> Column:
    """D6 alone if it holds, else up to five reasons of D4 and D5 joined, null if the image may stay."""
    valid = valid_fragments(fragments, rules)
    phrase = phrase_reason(valid, rules)
    reasons = F.concat(F.filter(F.array(phrase), lambda x: x.isNotNull()), fragment_reasons(valid, height, width, rules))
    joined = F.array_join(F.slice(reasons, 1, rules.reasons), " | ")
    return F.coalesce(placeholder_reason(valid, rules), F.when(joined != "", joined))


def with_saturation(height: Column, width: Column, rgb: Column, fragments: Column) -> Column:
    """Mean saturation of each fragment's box, in order."""

    @F.pandas_udf("array<double>")
    def measure(h: pd.Series, w: pd.Series, data: pd.Series, boxes: pd.Series) -> pd.Series:
        def one(rows: int, columns: int, raw: bytes, own: list) -> list[float]:
            s, _ = saturation_value(np.frombuffer(raw, np.uint8).reshape(int(rows), int(columns), 3))
            out = []
            for box in own:
                points = np.array([list(p) for p in box], float)
                x1, y1 = (int(max(0.0, v)) for v in points.min(axis=0))
                x2, y2 = min(int(points[:, 0].max()), int(columns)), min(int(points[:, 1].max()), int(rows))
                out.append(float(s[y1:y2, x1:x2].mean()) if x2 > x1 and y2 > y1 else 0.0)
            return out

        return pd.Series([one(*x) for x in zip(h, w, data, boxes, strict=True)])

    boxes = F.transform(fragments, lambda r: r["bbox"])
    measured = measure(height, width, rgb, boxes)
    return F.zip_with(fragments, measured, lambda r, s: r.withField("saturation", s))


def judge_images(images: DataFrame, recognise: Callable[[DataFrame], DataFrame] | None = None, rules: Sequence[str] = ("d1", "d2", "d3"), text: TextRules = TextRules()) -> DataFrame:
    """``images(idx, col, height, width, rgb)`` to verdicts ``(idx, col, approved, reason)``.

    The slow stage runs on the survivors of the pixel rules alone: ``recognise`` adds ``fragments``; without it the text
    rules are off. An image that was never judged (no bytes) is rejected with ``failure``, if there is such a column.
    """
    failure = F.col("failure") if "failure" in images.columns else F.lit(None).cast("string")
    missing = F.col("rgb").isNull()
    fast = images.where(~missing).withColumn("reason", pixel_reason(F.col("height"), F.col("width"), F.col("rgb"), rules))
    lost = images.where(missing).select("idx", "col", F.lit(False).alias("approved"), F.coalesce(failure, F.lit("Sin imagen")).alias("reason"))
    out = lost.union(fast.where("reason is not null").select("idx", "col", F.lit(False), "reason"))
    return out.union(_judge_survivors(fast.where("reason is null"), recognise, text))


def _judge_survivors(images: DataFrame, recognise: Callable[[DataFrame], DataFrame] | None, text: TextRules) -> DataFrame:
    """Verdicts of the images that no pixel rule rejects."""
    if recognise is None:
        return images.select("idx", "col", F.lit(True).alias("approved"), F.lit("").alias("reason"))
    read = recognise(images).withColumn("fragments", with_saturation(F.col("height"), F.col("width"), F.col("rgb"), F.col("fragments")))
    judged = read.withColumn("reason", text_reason("fragments", F.col("height"), F.col("width"), text))
    return judged.select("idx", "col", F.col("reason").isNull().alias("approved"), F.coalesce("reason", F.lit("")).alias("reason"))


def examine_urls(tasks: DataFrame, options: FetchOptions = FetchOptions(), rules: Sequence[str] = ("d1", "d2", "d3"), longest: int | None = 1280, pixels: bool = True) -> DataFrame:
    """``tasks(idx, col, url)`` fetched, decoded and put to the pixel rules in one pass: ``idx, col, reason, height, width, rgb``.

    Neither a file's content nor a rejected image's pixels leave the worker; with ``pixels`` off none do. An image that
    could not be fetched or decoded, or whose judging failed, has that as its reason.
    """

    def judge(content: bytes | None, failure: str | None) -> tuple[str | None, int | None, int | None, bytes | None]:
        if content is None:
            return f"No se pudo descargar: {failure}", None, None, None
        try:
            image = decode_bounded(content, longest)
            reason = first_reason(image, rules)
        except BadImage:
            return "Descargada, pero no es una imagen válida o supera los límites", None, None, None
        except Exception:  # noqa: BLE001  one image must not end the run
            return "Fallo interno al procesar la imagen", None, None, None
        return reason, *image.shape[:2], image.tobytes() if pixels and reason is None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in fetched(batches, options):
            for at in range(0, len(group), 8):
                part = group.iloc[at : at + 8]
                found = [judge(c, f) for c, f in zip(part["content"], part["failure"], strict=True)]
                yield part[["idx", "col"]].assign(**{name: pd.Series([x[i] for x in found], part.index, object) for i, name in enumerate(("reason", "height", "width", "rgb"))})

    return tasks.select("idx", "col", "url").mapInPandas(run, "idx long, col string, reason string, height int, width int, rgb binary")


def judge_urls(tasks: DataFrame, options: FetchOptions = FetchOptions(), recognise: Callable[[DataFrame], DataFrame] | None = None, rules: Sequence[str] = ("d1", "d2", "d3"), text: TextRules = TextRules(), longest: int | None = 1280) -> DataFrame:
    """``tasks(idx, col, url)`` to verdicts ``(idx, col, approved, reason)``; only survivors of the pixel rules are read.

    Without ``recognise`` each image is fetched once. With it the result is a union of two passes, so write the examined
    images first (``resume`` does) where fetching twice matters.
    """
    return _verdicts(examine_urls(tasks, options, rules, longest, recognise is not None), recognise, text)


def _verdicts(examined: DataFrame, recognise: Callable[[DataFrame], DataFrame] | None, text: TextRules) -> DataFrame:
    if recognise is None:
        return examined.select("idx", "col", F.col("reason").isNull().alias("approved"), F.coalesce("reason", F.lit("")).alias("reason"))
    rejected = examined.where("reason is not null").select("idx", "col", F.lit(False).alias("approved"), "reason")
    return rejected.union(_judge_survivors(examined.where("reason is null").drop("reason"), recognise, text))


def resume(df: DataFrame, columns: Sequence[str], store: str, batches: int = 16, options: FetchOptions = FetchOptions(), recognise: Callable[[DataFrame], DataFrame] | None = None, rules: Sequence[str] = ("d1", "d2", "d3"), text: TextRules = TextRules(), order: str = "_ord", tasks: int | None = None) -> DataFrame:
    """Judges the image cells that have no verdict in ``store`` and returns the verdicts of all.

    The cells are dealt to ``batches`` by a hash of their place; each batch is added to the store when it is done, so a run
    that is cut off goes on with the others. ``tasks`` is the number of partitions of a batch (the session's shuffle
    partitions unless given): fetching waits rather than computes, and a few rows may mean many images. With a recogniser
    the images that it must read are written beside the store for the time of a batch, so none is fetched twice.
    """
    spark = df.sparkSession
    begin = next_batch(spark, store)
    parts = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(batches):
        left = pending(df, columns, load_verdicts(spark, store), order)
        own = left.where(F.pmod(F.xxhash64("idx", "col"), F.lit(batches)) == k).repartition(parts, "idx", "col")
        examined = examine_urls(own, options, rules, pixels=recognise is not None)
        if recognise is not None:
            path = f"{store.rstrip('/')}_examined"
            examined.write.mode("overwrite").parquet(path)
            examined = spark.read.parquet(path)
        append_verdicts(_verdicts(examined, recognise, text), store, begin + k)
        if recognise is not None:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return load_verdicts(spark, store)
