"""Wild projections of many targets: what tasks add up has the size of replicates and components alone."""

import numpy as np
import pandas as pd

from kurvex.operators import wild


def test_sums_do_not_follow_the_targets(spark, monkeypatch):
    rng = np.random.default_rng(0)
    z, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    scored = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(z, y, strict=True))], "curve_id long, scores array<double>, y double").repartition(3)
    seen, add_up = [], wild.add_up
    monkeypatch.setattr(wild, "add_up", lambda parts: (r := add_up(parts), seen.append(max(len(v) for v in r.first())))[0])
    targets = lambda n: pd.DataFrame({"curve_id": range(n), "scores": [z[k % 60].tolist() for k in range(n)]})
    few, many = (wild.wild_projection(scored, "y", targets(n), 2, 3, 20) for n in (2, 300))
    assert max(seen) <= 20 * (3 + 9) and seen[:2] == seen[2:]
    assert np.allclose(many.roots[:, :2], few.roots, rtol=1e-9) and np.allclose(many.se[60:62], few.se, rtol=1e-12)
