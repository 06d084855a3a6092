import numpy as np

from lagwise.operators import residuals


def test_principal_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6))
    panel = spark.createDataFrame([(t, i, f"a{i}", float(x[t, i])) for t in range(40) for i in range(6)], "t int, asset_idx int, asset string, r double")
    got = residuals.principal(panel, 2).toPandas().pivot(index="t", columns="asset_idx", values="r").to_numpy()
    d = x - x.mean(axis=0)
    u, s, v = np.linalg.svd(d, full_matrices=False)
    assert np.allclose(got, d - (u[:, :2] * s[:2]) @ v[:2], atol=1e-9)
