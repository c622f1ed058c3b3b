import numpy as np
import pandas as pd

from stratoloom.llm.clusters import fit_mixture, similarity_clusters


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "vec": x.astype(np.float32).tolist()}), "id long, vec array<float>")


def test_mixture_is_fitted_on_all_rows(spark):
    rng = np.random.default_rng(1)
    counts = [9_000, 3_003, 7]
    x = np.repeat(np.eye(8)[:3], counts, axis=0) + 1e-3 * rng.standard_normal((sum(counts), 8))
    m = fit_mixture(frame(spark, x), components=(3,))
    # the groups lie apart, so that the weights are the groups' shares of all rows
    assert np.allclose(sorted(m.weights * len(x)), sorted(counts), atol=0.01)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for w, c in zip(m.weights, m.centres):
        at = np.flatnonzero(np.abs(m.log_parts(m.features(unit)).argmax(1) - np.flatnonzero(m.weights == w)[0]) == 0)
        assert np.allclose(m.features(unit[at]).mean(0), c, atol=1e-6)


def test_mixture_of_few_and_of_equal_rows(spark):
    same = frame(spark, np.ones((40, 4)))
    assert len(fit_mixture(same).weights) == 1 and similarity_clusters(same).select("cluster_key").distinct().count() == 1
    assert len(fit_mixture(frame(spark, np.eye(4)[:2])).weights) <= 2
    assert fit_mixture(same.limit(0)) is None
