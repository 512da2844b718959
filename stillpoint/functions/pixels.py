"""Pixel kernels on numpy arrays: grey frames are float arrays of shape (n, h, w) or (h, w)."""

from __future__ import annotations

import numpy as np

CONTENT_MARGIN = (0.12, 0.10)
METRIC_SIZE = (160, 90)


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of RGB pixels (ITU-R 601), 0 to 255."""
    if rgb.shape[-1] == 1:
        return rgb[..., 0].astype(np.float64)
    return np.floor((299 * rgb[..., 0].astype(np.int64) + 587 * rgb[..., 1].astype(np.int64) + 114 * rgb[..., 2].astype(np.int64)) / 1000 + 0.5)


def _weights(old: int, new: int, kernel: str) -> np.ndarray:
    """new x old weights of a separable resampling whose support widens when the image shrinks."""
    reach = 3.0 if kernel == "lanczos" else 1.0
    scale = max(old / new, 1.0)
    centre = (np.arange(new) + 0.5) * old / new
    x = (np.arange(old)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < reach, np.sinc(x) * np.sinc(x / reach) if kernel == "lanczos" else 1 - np.abs(x), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(frames: np.ndarray, width: int, height: int, kernel: str = "lanczos") -> np.ndarray:
    """Resample the last two axes; values are rounded and clipped to 0..255."""
    rows, cols = _weights(frames.shape[-2], height, kernel), _weights(frames.shape[-1], width, kernel)
    return np.clip(np.rint(rows @ frames @ cols.T), 0, 255)


def difference_hash(frame: np.ndarray, size: int = 8) -> int:
    """size*size bits of a centred square: whether a pixel exceeds its right neighbour, row by row, first bit highest."""
    if size <= 0:
        raise ValueError("size must be positive")
    h, w = frame.shape
    side = min(h, w)
    top, left = (h - side) // 2, (w - side) // 2
    small = resize(frame[top : top + side, left : left + side], size + 1, size)
    bits = (small[:, :-1] > small[:, 1:]).reshape(-1)
    return int("".join("1" if b else "0" for b in bits), 2)


def signed64(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _pad(frames: np.ndarray) -> np.ndarray:
    return np.pad(frames, [(0, 0)] * (frames.ndim - 2) + [(1, 1), (1, 1)], mode="edge")


def sharpness(frames: np.ndarray) -> np.ndarray:
    """Population variance of the four-neighbour Laplacian."""
    p = _pad(frames.astype(np.float64))
    lap = p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * p[..., 1:-1, 1:-1]
    return lap.var(axis=(-2, -1))


def edges(frames: np.ndarray) -> np.ndarray:
    """Magnitude of the 3x3 Sobel gradient, edges padded."""
    p = _pad(frames.astype(np.float64))
    gx = (p[..., :-2, 2:] + 2 * p[..., 1:-1, 2:] + p[..., 2:, 2:]) - (p[..., :-2, :-2] + 2 * p[..., 1:-1, :-2] + p[..., 2:, :-2])
    gy = (p[..., 2:, :-2] + 2 * p[..., 2:, 1:-1] + p[..., 2:, 2:]) - (p[..., :-2, :-2] + 2 * p[..., :-2, 1:-1] + p[..., :-2, 2:])
    return np.hypot(gx, gy)


def histogram_entropy(frames: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Entropy in bits, and non-empty buckets, of each frame's histogram of values // step."""
    flat = (frames.reshape(len(frames), -1).astype(np.int64) // step).clip(0, 255 // step)
    k = 256 // step
    counts = np.bincount((flat + np.arange(len(flat))[:, None] * k).reshape(-1), minlength=len(flat) * k).reshape(len(flat), k)
    p = counts / flat.shape[1]
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1), (counts > 0).sum(1)


def text_lines(edge: np.ndarray, bands: int = 30, quantile: float = 75.0, least_edge: float = 12.0, least_density: float = 0.08) -> np.ndarray:
    """Share of horizontal bands that are dense in strong edges, as lines of text are."""
    n, h, _ = edge.shape
    strong = edge >= np.maximum(np.percentile(edge.reshape(n, -1), quantile, axis=1), least_edge)[:, None, None]
    height = h // bands
    density = strong[:, : bands * height].reshape(n, bands, -1).mean(2)
    return (density >= least_density).mean(1)


def content_crop(frame: np.ndarray, margin: tuple[float, float] = CONTENT_MARGIN) -> np.ndarray:
    """The frame without its outer margins; a pixel stays at least."""
    h, w = frame.shape[-2:]
    x, y = int(w * margin[0]), int(h * margin[1])
    return frame[..., y : max(y + 1, h - y), x : max(x + 1, w - x)]


def mean_abs_delta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a.astype(np.float64) - b).mean(axis=(-2, -1))


def frame_metrics(frames: np.ndarray) -> dict[str, np.ndarray]:
    """Raw metrics of a stack of grey frames at the metric size; normalising and neighbours are left to window functions."""
    edge = edges(frames)
    ent, _ = histogram_entropy(frames)
    visual, buckets = histogram_entropy(frames, 8)
    step = np.abs(np.diff(frames, axis=1)).mean(axis=(1, 2)) + np.abs(np.diff(frames, axis=2)).mean(axis=(1, 2)) if frames.shape[1] > 1 and frames.shape[2] > 1 else np.zeros(len(frames))
    return {
        "dark": (frames <= 24).mean(axis=(1, 2)), "bright": (frames >= 232).mean(axis=(1, 2)), "edge": edge.mean(axis=(1, 2)), "text_lines": text_lines(edge), "entropy_256": ent,
        "entropy": visual, "buckets": buckets.astype(np.int64), "stddev": frames.std(axis=(1, 2)), "neighbour_step": step, "sharpness": sharpness(frames),
    }
