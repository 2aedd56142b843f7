import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels as K


def test_motion_and_screening_udfs(spark):
    rng = np.random.default_rng(0)
    clip = rng.integers(0, 255, (2, 12, 16, 3), dtype=np.uint8)
    still = np.repeat(clip[:1], 2, 0)
    rows = [(i, bytearray(c.tobytes()), list(c.shape)) for i, c in enumerate((clip, still, np.moveaxis(clip, -1, 1).copy()))] + [(3, None, None)]
    df = spark.createDataFrame(rows, "id int, v binary, s array<int>")
    got = {r.id: r.m for r in df.select("id", K.motion("v", "s").alias("m")).collect()}
    want = np.abs(clip[1].astype(float) - clip[0]).mean() / 255
    assert got[0].overall == pytest.approx(want) == got[2].overall and got[1].peak == 0 and got[3].overall is None
    vec = {r.id: r.x for r in df.select("id", K.screening("v", "s").alias("x")).collect()}
    assert np.dot(vec[0], vec[2]) == pytest.approx(1.0) and np.linalg.norm(vec[1]) == pytest.approx(1.0)


def test_geometry():
    k = np.array([[100.0, 0, 8], [0, 100, 6], [0, 0, 1]])
    assert np.allclose(K.rotation_homography(k, k, np.eye(4), np.eye(4)), np.eye(3))
    flow, valid = K.camera_flow(np.array([[1, 0, 2.0], [0, 1, 0], [0, 0, 1]]), 12, 16)
    assert np.allclose(flow[..., 0], 2) and valid.sum() == 12 * 14
    error, fine = K.round_trip(flow, -flow)
    assert error[fine].max() < 1e-9 and fine.sum() == 12 * 14
    assert np.allclose(K.residual_flow(flow, valid), 0)
    pose = np.eye(4)
    pose[:3, 3] = [1, 2, 3]
    assert np.allclose(K.inverse_pose(pose) @ pose, np.eye(4))
    assert np.allclose(K.rescaled_camera(k, (12, 16), (24, 32))[:2], 2 * k[:2])
    mask = np.zeros((12, 16))
    mask[3, 4] = 1
    moved, ok = K.carried_mask(mask, flow, valid)
    assert ok and moved[3, 6] and moved.sum() == 1
    assert np.allclose(K.pooled(np.array([[1.0], [3.0]]), np.array([0.0, 2.0])), 3)


def test_joint_deltas(spark):
    a = spark.createDataFrame([(1, "wrist", 0.0, 0.0, 0.0), (1, "elbow", 1.0, 1.0, 1.0), (2, "wrist", 0.0, 0.0, 0.0)], "id int, joint string, x double, y double, z double")
    b = spark.createDataFrame([(1, "wrist", 1.0, 2.0, 3.0), (2, "elbow", 1.0, 2.0, 3.0)], a.schema)
    assert [tuple(r) for r in K.joint_deltas(a, b, "id").collect()] == [(1, "wrist", 1.0, 2.0, 3.0)]
    assert K.joint_deltas(a, b, "id", least=2).agg(F.count("*")).first()[0] == 0
