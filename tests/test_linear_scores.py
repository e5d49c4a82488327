import numpy as np
import pytest

from gridloom.operators import probes


def test_kept_weights_score_as_the_model_does(spark):
    draw = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, [float(x) for x in v], int(v[0] > 0)) for i, v in enumerate(draw.normal(size=(200, 4)))], "i int, features array<double>, label int")
    model = probes.fit_probe(rows)
    weights, bias = probes.weights_of(model)
    want = {r.i: r.score for r in probes.scored(model, rows).collect()}
    got = {r.i: r.score for r in probes.linear_scored(rows, weights, bias).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9
    with pytest.raises(Exception, match="values expected"):
        probes.linear_scored(rows, weights[:3], bias).collect()
