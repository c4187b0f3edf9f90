import numpy as np

from prismlake.operators import paths
from prismlake.operators.bundle import turned


def test_frames_go_through_the_keys(spark):
    rng = np.random.default_rng(3)
    r, c = turned(rng.normal(size=(5, 3))), rng.normal(size=(5, 3))
    rows = [(10 * k, r[k].ravel().tolist(), (-r[k] @ c[k]).tolist()) for k in range(5)]
    keys = spark.createDataFrame(rows, "img_id int, R array<double>, t array<double>").repartition(3)
    got = paths.key_frame_path(keys, 17, "img_id").orderBy("frame").collect()
    assert [x.frame for x in got] == list(range(17))
    for k, x in enumerate(got):
        m, t = np.array(x.R).reshape(3, 3), np.array(x.t)
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-9)
        i, share = min(k // 4, 3), k / 4 - min(k // 4, 3)
        assert np.allclose(-m.T @ t, c[i] + share * (c[i + 1] - c[i]), atol=1e-9)
        if k % 4 == 0:
            assert np.allclose(m, r[k // 4], atol=1e-9)
        else:  # the turn from the key before grows evenly
            angle = lambda a, b: np.arccos(np.clip((np.trace(a @ b.T) - 1) / 2, -1, 1))
            assert np.isclose(angle(m, r[i]), share * angle(r[i + 1], r[i]), atol=1e-3)
    still = paths.key_frame_path(keys.where("img_id = 20"), 3, "img_id").collect()
    assert len(still) == 3 and all(np.allclose(x.R, r[2].ravel()) for x in still)
    assert paths.key_frame_path(keys.limit(0), 3, "img_id").count() == 0
