"""Text recognition around two pluggable models: box finding, line grouping, crops, decoding.

The models (a detector that gives text and link maps at half size, a recogniser that gives class scores per step) are
ONNX files named by the caller; none ship with the library. Everything else is numpy and can be tested without them.
Images are ``h x w x 3`` arrays in red, green, blue order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Sizes and thresholds of the recognition chain are fixed values.
CANVAS, TEXT, LINK, LOW = 2560, 0.7, 0.4, 0.4
MIN_SIDE, HEIGHT, MAX_WIDTH = 20.0, 64, 2048
SLOPE, CENTRE, TALL, WIDE, MARGIN = 0.1, 0.5, 0.5, 0.5, 0.1
MEAN, SPREAD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
SCHEMA = "array<struct<bbox: array<array<float>>, text: string, confidence: float>>"


def softmax(scores: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def crossed_grey(rgb: np.ndarray) -> np.ndarray:
    """Grey with the weights of red and blue exchanged, which is what the recogniser was trained on."""
    return np.clip(np.floor(rgb.astype(np.float64) @ np.array([0.114, 0.587, 0.299]) + 0.5), 0, 255).astype(np.uint8)


# Resampling


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(x))


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


def _weights(source: int, target: int, kernel: Callable, support: float) -> np.ndarray:
    """Row-normalised ``target x source`` weights; the kernel widens when shrinking."""
    scale = max(1.0, source / target)
    centres = (np.arange(target) + 0.5) * source / target
    w = kernel((np.arange(source)[None, :] + 0.5 - centres[:, None]) / scale)
    w[np.abs(np.arange(source)[None, :] + 0.5 - centres[:, None]) > support * scale] = 0
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int, cubic: bool = False) -> np.ndarray:
    kernel, support = (_cubic, 2.0) if cubic else (_triangle, 1.0)
    planes = image[..., None] if image.ndim == 2 else image
    down = np.tensordot(_weights(image.shape[0], height, kernel, support), planes.astype(np.float64), axes=(1, 0))
    both = np.moveaxis(np.tensordot(_weights(image.shape[1], width, kernel, support), down, axes=(1, 1)), 0, 1)
    return np.clip(np.floor(both + 0.5), 0, 255).astype(np.uint8).reshape((height, width, *image.shape[2:]))


def fit(image: np.ndarray, longest: int) -> np.ndarray:
    """The longest side at most ``longest``, aspect kept."""
    h, w = image.shape[:2]
    if max(h, w) <= longest:
        return image
    scale = np.float32(longest) / np.float32(max(h, w))
    return resize(image, max(1, int(h * scale)), max(1, int(w * scale)))


def canvas(image: np.ndarray, square: int = CANVAS) -> tuple[np.ndarray, float]:
    """Aspect kept, padded with black to multiples of 32; and the scale applied."""
    h, w = image.shape[:2]
    ratio = min(max(h, w), square) / max(h, w)
    small = resize(image, max(1, int(h * ratio)), max(1, int(w * ratio)))
    out = np.zeros((-(-small.shape[0] // 32) * 32, -(-small.shape[1] // 32) * 32, 3), np.uint8)
    out[: small.shape[0], : small.shape[1]] = small
    return out, ratio


def normalise(image: np.ndarray) -> np.ndarray:
    return ((image - MEAN * 255) / (SPREAD * 255)).astype(np.float32)


# Boxes


def regions(mask: np.ndarray) -> np.ndarray:
    """Labels of 4-connected regions from 1 in scan order, 0 elsewhere; runs of rows are joined by union-find."""
    labels, parent = np.zeros(mask.shape, np.int64), [0]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            above = np.unique(labels[y - 1, a:b]) if y else np.zeros(1, np.int64)
            roots = sorted({root(int(x)) for x in above if x})
            if not roots:
                roots = [len(parent)]
                parent.append(len(parent))
            for other in roots[1:]:
                parent[other] = roots[0]
            labels[y, a:b] = roots[0]
    final = {r: i for i, r in enumerate(dict.fromkeys(root(x) for x in range(1, len(parent))), 1)}
    return np.array([0, *[final[root(x)] for x in range(1, len(parent))]])[labels]


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    """With a square of the given radius."""
    if radius < 1:
        return mask
    padded, size = np.pad(mask, radius), 2 * radius + 1
    wide = np.lib.stride_tricks.sliding_window_view(padded, size, axis=1).any(axis=-1)
    return np.lib.stride_tricks.sliding_window_view(wide, size, axis=0).any(axis=-1)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    order = sorted(map(tuple, points.tolist()))

    def chain(sequence: Sequence[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in sequence:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    if len(order) < 3:
        return np.array(order, float)
    return np.array(chain(order)[:-1] + chain(order[::-1])[:-1], float)


def smallest_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of least area around the points, one side along an edge of the hull."""
    corners = hull(points)
    if len(corners) < 3:
        low, high = corners.min(axis=0), corners.max(axis=0)
        return np.array([low, [high[0], low[1]], high, [low[0], high[1]]])
    best, shape = np.inf, None
    for side in np.roll(corners, -1, axis=0) - corners:
        u = side / np.hypot(*side)
        turn = np.array([u, [-u[1], u[0]]])
        turned = corners @ turn.T
        low, high = turned.min(axis=0), turned.max(axis=0)
        area = np.prod(high - low)
        if area < best - 1e-9:
            best, shape = area, np.array([low, [high[0], low[1]], high, [low[0], high[1]]]) @ turn
    return shape


def text_boxes(text: np.ndarray, link: np.ndarray, strong: float = TEXT, joined: float = LINK, low: float = LOW) -> list[np.ndarray]:
    """Quadrilaterals around the words of two score maps, clockwise from the corner nearest the origin."""
    is_text, is_link = text > low, link > joined
    labels = regions(is_text | is_link)
    found = []
    for label in range(1, labels.max(initial=0) + 1):
        own = labels == label
        area = int(own.sum())
        if area < 10 or text[own].max() < strong:
            continue
        ys, xs = np.nonzero(own)
        w, h = xs.max() - xs.min() + 1, ys.max() - ys.min() + 1
        grow = int(np.sqrt(area * min(w, h) / (w * h)) * 2)
        ys, xs = np.nonzero(dilate(own & ~(is_link & ~is_text), (1 + grow) // 2))
        if not len(xs):
            continue
        box = smallest_rectangle(np.column_stack([xs, ys]))
        a, b = np.hypot(*(box[1] - box[0])), np.hypot(*(box[2] - box[1]))
        if abs(1 - max(a, b) / (min(a, b) + 1e-5)) <= 0.1:
            box = np.array([[xs.min(), ys.min()], [xs.max(), ys.min()], [xs.max(), ys.max()], [xs.min(), ys.max()]], float)
        found.append(np.roll(box, -int(box.sum(axis=1).argmin()), axis=0))
    return found


@dataclass(frozen=True)
class Grouping:
    slope: float = SLOPE
    centre: float = CENTRE
    height: float = TALL
    width: float = WIDE
    margin: float = MARGIN


def _padded(boxes: list[tuple], margin: float) -> list[float]:
    x1, x2 = min(b[0] for b in boxes), max(b[1] for b in boxes)
    y1, y2 = min(b[2] for b in boxes), max(b[3] for b in boxes)
    room = int(margin * min(x2 - x1, y2 - y1))
    return [x1 - room, x2 + room, y1 - room, y2 + room]


def group_lines(quads: Sequence[np.ndarray], rules: Grouping = Grouping()) -> tuple[list[list[float]], list[np.ndarray]]:
    """Level boxes merged along text lines as ``[x1, x2, y1, y2]``, and tilted quadrilaterals with a margin."""
    level: list[tuple] = []
    tilted: list[np.ndarray] = []
    for q in quads:
        (x0, y0), (x1, y1), (x2, y2), (x3, y3) = q
        up, down = (y1 - y0) / max(x1 - x0, 10.0), (y2 - y3) / max(x2 - x3, 10.0)
        if max(abs(up), abs(down)) < rules.slope:
            level.append((q[:, 0].min(), q[:, 0].max(), q[:, 1].min(), q[:, 1].max()))
            continue
        room = int(1.44 * rules.margin * min(np.hypot(x1 - x0, y1 - y0), np.hypot(x3 - x0, y3 - y0)))
        a = abs(np.arctan((y0 - y2) / max(x0 - x2, 10.0)))
        b = abs(np.arctan((y1 - y3) / max(x1 - x3, 10.0)))
        away = np.array([[-np.cos(a), -np.sin(a)], [np.cos(b), -np.sin(b)], [np.cos(a), np.sin(a)], [-np.cos(b), np.sin(b)]])
        tilted.append(q + room * away)
    lines: list[list[tuple]] = []
    for box in sorted(level, key=lambda b: (b[2] + b[3]) / 2):
        if lines:
            heights = np.mean([b[3] - b[2] for b in lines[-1]])
            centres = np.mean([(b[2] + b[3]) / 2 for b in lines[-1]])
            if abs(centres - (box[2] + box[3]) / 2) < rules.centre * heights:
                lines[-1].append(box)
                continue
        lines.append([box])
    merged = []
    for line in lines:
        run: list[tuple] = []
        for box in sorted(line, key=lambda b: b[0]):
            if run:
                mean = np.mean([b[3] - b[2] for b in run])
                close = box[0] - run[-1][1] < rules.width * (box[3] - box[2])
                if not (abs(mean - (box[3] - box[2])) < rules.height * mean and close):
                    merged.append(_padded(run, rules.margin))
                    run = []
            run.append(box)
        merged.append(_padded(run, rules.margin))
    return merged, tilted


# Crops


def crop_level(grey: np.ndarray, box: Sequence[float]) -> np.ndarray:
    h, w = grey.shape
    x1, y1 = round(max(0.0, box[0])), round(max(0.0, box[2]))
    x2, y2 = max(round(min(box[1], w)), x1), max(round(min(box[3], h)), y1)
    return grey[y1 : max(y2, y1 + 1), x1 : max(x2, x1 + 1)]


def crop_tilted(grey: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The quadrilateral straightened to a rectangle, sampled bilinearly, black outside."""
    tl, tr, br, bl = np.asarray(quad, float)
    width = max(int(np.hypot(*(br - bl))), int(np.hypot(*(tr - tl))), 1)
    height = max(int(np.hypot(*(tr - br))), int(np.hypot(*(tl - bl))), 1)
    flat = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    rows, target = [], []
    for (u, v), (x, y) in zip(flat, (tl, tr, br, bl), strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        target += [x, y]
    try:
        m = np.append(np.linalg.solve(np.array(rows), np.array(target)), 1).reshape(3, 3)
    except np.linalg.LinAlgError:
        return np.zeros((height, width), np.uint8)
    v, u = np.mgrid[0:height, 0:width]
    at = m @ np.stack([u.ravel(), v.ravel(), np.ones(u.size)])
    x, y = at[0] / at[2], at[1] / at[2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    inside = (x0 >= 0) & (y0 >= 0) & (x0 < grey.shape[1]) & (y0 < grey.shape[0])
    x0, y0 = np.clip(x0, 0, grey.shape[1] - 1), np.clip(y0, 0, grey.shape[0] - 1)
    x1, y1 = np.minimum(x0 + 1, grey.shape[1] - 1), np.minimum(y0 + 1, grey.shape[0] - 1)
    fx, fy = x - np.floor(x), y - np.floor(y)
    g = grey.astype(float)
    value = (g[y0, x0] * (1 - fx) + g[y0, x1] * fx) * (1 - fy) + (g[y1, x0] * (1 - fx) + g[y1, x1] * fx) * fy
    return np.where(inside, np.floor(value + 0.5), 0).astype(np.uint8).reshape(height, width)


def bucket_width(ratio: float, height: int = HEIGHT) -> int:
    return max(1, int(np.ceil(max(ratio, 1.0)))) * height


def recogniser_input(crop: np.ndarray, height: int = HEIGHT) -> np.ndarray | None:
    """``1 x height x bucket`` in -1 to 1, the last column repeated; None for an empty or absurdly long crop."""
    h, w = crop.shape
    if not h or not w:
        return None
    ratio = max(w / h, h / w)
    small = resize(crop, max(1, int(height * ratio)), height) if w < h else resize(crop, height, max(1, int(height * ratio)))
    bucket = bucket_width(ratio, height)
    if bucket > MAX_WIDTH:
        return None
    width = max(1, min(bucket, int(np.ceil(height * small.shape[1] / small.shape[0]))))
    scaled = resize(small, height, width, cubic=True).astype(np.float32) / 255
    return np.pad((scaled - 0.5) / 0.5, ((0, 0), (0, bucket - width)), mode="edge")[None]


# Decoding


def mask_languages(probabilities: np.ndarray, characters: str, allowed: str) -> np.ndarray:
    """Class 0 is the blank; classes of other characters get nothing and each step adds up to one again."""
    keep = np.array([True, *[c in set(allowed) for c in characters]])
    kept = probabilities * keep
    total = kept.sum(axis=1, keepdims=True)
    return np.divide(kept, total, out=kept.copy(), where=total > 0)


def confidence(best: np.ndarray) -> float:
    """``prod(p) ** (2 / sqrt(n))``, 0 for no steps."""
    return float(np.prod(best) ** (2 / np.sqrt(len(best)))) if len(best) else 0.0


def decode(probabilities: np.ndarray, characters: str) -> tuple[str, float]:
    """Best class of each step, repeats and blanks collapsed; confidence over all steps that are no blank."""
    best = probabilities.argmax(axis=1)
    new = np.concatenate([[True], best[1:] != best[:-1]]) & (best != 0)
    return "".join(characters[i - 1] for i in best[new]), confidence(probabilities.max(axis=1)[best != 0])


class Reader:
    """Reads the text of an image with a detector and a recogniser.

    ``detect`` maps a ``1 x 3 x h x w`` array to ``1 x h/2 x w/2 x 2`` maps; ``recognise`` maps ``1 x 1 x 64 x w`` to
    ``1 x steps x classes`` scores.
    """

    def __init__(self, detect: Callable[[np.ndarray], np.ndarray], recognise: Callable[[np.ndarray], np.ndarray], characters: str, allowed: str):
        self.detect, self.recognise, self.characters, self.allowed = detect, recognise, characters, allowed

    @classmethod
    def from_files(cls, detector: str, recogniser: str, characters: str, allowed: str) -> Reader:
        import onnxruntime

        def model(path: str) -> Callable[[np.ndarray], np.ndarray]:
            session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
            name = session.get_inputs()[0].name
            return lambda x: session.run(None, {name: x})[0]

        return cls(model(detector), model(recogniser), characters, allowed)

    def boxes(self, rgb: np.ndarray) -> tuple[list[list[float]], list[np.ndarray]]:
        drawn, ratio = canvas(rgb)
        maps = self.detect(normalise(drawn).transpose(2, 0, 1)[None])
        if maps.ndim != 4 or maps.shape[0] != 1 or maps.shape[3] < 2:
            raise ValueError(f"the detector gave {maps.shape}, not (1, height, width, 2)")
        quads = [np.trunc(q * 2 / ratio) for q in text_boxes(maps[0, :, :, 0], maps[0, :, :, 1])]
        level, tilted = group_lines(quads)
        return [b for b in level if max(b[1] - b[0], b[3] - b[2]) > MIN_SIDE], [q for q in tilted if np.ptp(q, axis=0).max() > MIN_SIDE]

    def read(self, rgb: np.ndarray) -> list[dict]:
        grey = crossed_grey(rgb)
        level, tilted = self.boxes(rgb)
        shapes = [(crop_level(grey, b), [[b[0], b[2]], [b[1], b[2]], [b[1], b[3]], [b[0], b[3]]]) for b in level]
        shapes += [(crop_tilted(grey, q), q.tolist()) for q in tilted]
        out = []
        for crop, bbox in shapes:
            tensor = recogniser_input(crop)
            if tensor is None:
                continue
            scores = self.recognise(tensor[None].astype(np.float32))
            if scores.ndim != 3 or scores.shape[0] != 1:
                raise ValueError(f"the recogniser gave {scores.shape}, not (1, steps, classes)")
            text, sure = decode(mask_languages(softmax(scores[0]), self.characters, self.allowed), self.characters)
            out.append({"bbox": bbox, "text": text, "confidence": sure})
        return out


def recogniser(make: Callable[[], Reader], longest: int = 900) -> Callable[[DataFrame], DataFrame]:
    """A slow stage for ``judge_images``: adds ``fragments``; the reader is made once per task.

    An image whose reading fails has no fragments and the error in ``failure``; the others go on.
    """

    def stage(images: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = make()
            for batch in batches:
                found, errors = [], []
                for h, w, raw in zip(batch["height"], batch["width"], batch["rgb"], strict=True):
                    try:
                        image = fit(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3), longest)
                        scale = h / image.shape[0]
                        read = reader.read(image)
                        found.append([{**r, "bbox": (np.array(r["bbox"]) * scale).tolist()} for r in read])
                        errors.append(None)
                    except Exception as error:  # noqa: BLE001  one bad image must not end the batch
                        found.append([])
                        errors.append(str(error))
                yield batch.assign(fragments=found, ocr_failure=errors)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields)
        return images.mapInPandas(run, f"{fields}, fragments {SCHEMA}, ocr_failure string")

    return stage
