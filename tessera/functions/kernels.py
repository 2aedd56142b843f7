"""Array kernels for frame pairs, camera geometry and dense flow, offered as pandas UDFs.

A clip travels as BINARY (uint8, row major) with its shape as ARRAY<INT>; axes are time,
height, width, channel. Matrices are row-major arrays of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOTION = "struct<overall:double,peak:double,contrast:double,center:double>"


def clip_of(blob: bytes, shape) -> np.ndarray:
    """Float frames (time, height, width, channel) in 0..1; channel-first clips are moved."""
    x = np.frombuffer(blob, np.uint8).reshape(tuple(int(s) for s in shape)).astype(np.float64) / 255.0
    if x.ndim != 4 or x.shape[0] < 2:
        raise ValueError(f"a clip has four axes and two frames, not {x.shape}")
    return np.moveaxis(x, 1, -1) if x.shape[1] in (1, 3) and x.shape[-1] not in (1, 3) else x


def motion_features(clip: np.ndarray, cells: int = 4) -> tuple[float, float, float, float]:
    """Endpoint difference: mean, 90th percentile of a cell grid, their ratio, middle half."""
    change = np.abs(clip[-1] - clip[0]).mean(-1)
    h, w = change.shape
    rows, cols = (np.arange(min(cells, n)) * max(1, n // cells) for n in (h, w))
    sums = np.add.reduceat(np.add.reduceat(change, rows, 0), cols, 1)
    sizes = np.outer(np.diff(np.append(rows, h)), np.diff(np.append(cols, w)))
    overall, peak = float(change.mean()), float(np.percentile(sums / sizes, 90))
    middle = change[h // 4 : max(h // 4 + 1, 3 * h // 4), w // 4 : max(w // 4 + 1, 3 * w // 4)]
    return overall, peak, peak / (overall + 1e-6), float(middle.mean())


def screening_vector(clip: np.ndarray, side: int = 16) -> np.ndarray:
    """Unit vector of centred appearance (both ends) and centred change on a coarse grid."""
    gray = clip[[0, -1]].mean(-1)
    pick = [np.rint(np.linspace(0, n - 1, side)).astype(int) for n in gray.shape[1:]]
    small = gray[:, pick[0]][:, :, pick[1]]

    def unit(v: np.ndarray) -> np.ndarray:
        v = v - v.mean()
        return v / max(np.linalg.norm(v), 1e-8)

    joined = np.concatenate([unit(small.ravel()), unit((small[1] - small[0]).ravel())])
    return joined / max(np.linalg.norm(joined), 1e-8)


def rescaled_camera(k: np.ndarray, source: tuple[int, int], target: tuple[int, int]) -> np.ndarray:
    """Intrinsics for another (height, width)."""
    if min(*source, *target) <= 0:
        raise ValueError("image sizes are positive")
    return np.diag([target[1] / source[1], target[0] / source[0], 1.0]) @ np.asarray(k, float).reshape(3, 3)


def inverse_pose(pose: np.ndarray) -> np.ndarray:
    """Inverse of a rigid 4 x 4 transform."""
    r, t = np.asarray(pose, float)[:3, :3], np.asarray(pose, float)[:3, 3:]
    return np.block([[r.T, -r.T @ t], [np.zeros((1, 3)), np.ones((1, 1))]])


def rotation_homography(k0, k1, pose0, pose1) -> np.ndarray:
    """Pixels at the start to pixels at the end when only the camera's rotation counts."""
    turn = np.asarray(pose1, float)[:3, :3] @ np.asarray(pose0, float)[:3, :3].T
    h = np.asarray(k1, float) @ np.linalg.solve(np.asarray(k0, float).T, turn.T).T
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def _grid(h: int, w: int) -> np.ndarray:
    return np.stack(np.meshgrid(np.arange(w), np.arange(h)), -1).astype(float)


def _inside(xy: np.ndarray, h: int, w: int) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return ((xy >= 0) & (xy <= np.array([w - 1, h - 1]))).all(-1)


def camera_flow(homography: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(displacement, valid) of every pixel under a homography."""
    grid = _grid(h, w)
    moved = np.einsum("ij,hwj->hwi", np.asarray(homography, float), np.concatenate([grid, np.ones((h, w, 1))], -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        end = np.where(np.abs(moved[..., 2:]) > 1e-8, moved[..., :2] / moved[..., 2:], np.nan)
    return end - grid, _inside(end, h, w)


def looked_up(field: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear values of a field (height, width, depth) at pixel positions, and which are inside."""
    h, w = field.shape[:2]
    fine = _inside(xy, h, w)
    at = np.where(fine[..., None], xy, 0.0)
    low = np.minimum(np.floor(at).astype(int), [max(w - 2, 0), max(h - 2, 0)])
    part = at - low
    out = 0.0
    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
        share = np.abs(1 - dx - part[..., 0]) * np.abs(1 - dy - part[..., 1])
        out = out + field[np.minimum(low[..., 1] + dy, h - 1), np.minimum(low[..., 0] + dx, w - 1)] * share[..., None]
    return out, fine


def round_trip(forward: np.ndarray, backward: np.ndarray, most: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """(error, valid) of going along one flow and back along the other."""
    if forward.shape != backward.shape:
        raise ValueError("flows differ in shape")
    back, fine = looked_up(backward, _grid(*forward.shape[:2]) + forward)
    error = np.linalg.norm(forward + back, axis=-1)
    return error, fine & (error <= most)


def residual_flow(flow: np.ndarray, valid: np.ndarray, homography: np.ndarray | None = None) -> np.ndarray:
    """Flow minus the camera's; without a camera, minus the median shift of the valid pixels."""
    if homography is not None:
        return flow - camera_flow(homography, *flow.shape[:2])[0]
    return flow - (np.median(flow[valid], axis=0) if valid.any() else 0.0)


def carried_mask(mask: np.ndarray, flow: np.ndarray, valid: np.ndarray, least: float = 0.5) -> tuple[np.ndarray, bool]:
    """A mask moved along a flow; usable when enough of its pixels are consistent."""
    h, w = mask.shape
    on = mask.astype(bool)
    end = np.rint(_grid(h, w) + flow)
    live = on & valid & _inside(end, h, w)
    out = np.zeros((h, w), bool)
    x, y = end[live].astype(int).T if live.any() else (np.zeros(0, int), np.zeros(0, int))
    out[y, x] = True
    return out, bool(on.any() and live.sum() >= least * on.sum())


def pooled(tokens: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean of patch tokens by their share in a region; the plain mean without any."""
    total = weights.sum()
    return weights @ tokens / total if total > 0 else tokens.mean(0)


def motion(blob: str, shape: str) -> Column:
    """Motion features of a clip column, one Arrow batch at a time."""

    @F.pandas_udf(MOTION)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blobs, shapes in parts:
            rows = [(None,) * 4 if b is None or s is None else motion_features(clip_of(b, s)) for b, s in zip(blobs, shapes)]
            yield pd.DataFrame(rows, columns=["overall", "peak", "contrast", "center"])

    return run(F.col(blob), F.col(shape))


def screening(blob: str, shape: str) -> Column:
    """Screening vector of a clip column."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for blobs, shapes in parts:
            yield pd.Series([None if b is None or s is None else screening_vector(clip_of(b, s)) for b, s in zip(blobs, shapes)])

    return run(F.col(blob), F.col(shape))


def joint_deltas(start: DataFrame, end: DataFrame, key: str, joint: str = "joint", least: int = 1) -> DataFrame:
    """(key, joint, dx, dy, dz) of joints known at both ends, where a key has at least ``least``."""
    b = end.select(key, joint, *[F.col(c).alias(f"__{c}") for c in "xyz"])
    both = start.join(b, [key, joint]).dropna(subset=["x", "y", "z", "__x", "__y", "__z"])
    enough = both.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
    return both.join(enough, key, "left_semi").select(key, joint, *[(F.col(f"__{c}") - F.col(c)).alias(f"d{c}") for c in "xyz"])
