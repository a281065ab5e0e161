import math
import random

import pytest

from tidewheel.functions import expr as E
from tidewheel.plans.observe import finite_difference

X, Y = E.var(0), E.var(1)
KERNEL = E.square(X + Y) + E.abs_(X - 1.0)


def test_goldens():
    assert E.evaluate(KERNEL, [3, 5]) == 66
    assert E.gradient(KERNEL, [3, 5], 2) == [17, 16]
    assert E.infix(KERNEL) == "((x0 + x1)^2 + |(x0 - 1)|)"
    assert E.infix(E.simplify(E.diff(KERNEL, 1))) == "(2 * (x0 + x1))"
    assert len(E.trace(KERNEL, [3, 5])) == 9
    assert "\\left|" in E.latex(KERNEL)


def test_absence():
    assert E.evaluate(X + Y, [None, 1]) is None
    assert E.evaluate(E.min_(X, Y), [None, 1]) == 1 == E.evaluate(E.max_(X, Y), [1, None])
    assert E.evaluate(E.min_(X, Y), [None, None]) is None
    assert E.evaluate(E.or_(X, 2), [None]) == 2
    assert E.evaluate(E.present(X), [None]) == 0 and E.evaluate(E.present(X), [0]) == 1
    assert E.evaluate(X / Y, [1, 0]) is None
    with pytest.raises(E.Absent):
        E.lt(E.absent, 1)
    with pytest.raises(E.Absent):
        E.select(E.select(E.lt(X, 1), 1, E.absent), 1, 2)
    E.lt(E.or_(E.absent, 1), 2)


@pytest.mark.parametrize("seed", range(20))
def test_derivatives_meet_differences(seed):
    r = random.Random(seed)

    def tree(depth):
        if depth == 0:
            return r.choice([X, Y, E.lift(round(r.uniform(-2, 2), 2))])
        a, b = tree(depth - 1), tree(depth - 1)
        return r.choice([a + b, a - b, a * b, a / (E.square(b) + 1.0), -a, E.square(a), E.min_(a, b), E.max_(a, b), E.exp(E.min_(a, 2)), E.sqrt(E.square(a) + 1.0), E.powi(a, 3), E.select(E.lt(a, b), a, b)])

    e, at = tree(3), [r.uniform(0.5, 2), r.uniform(0.5, 2)]
    exact = E.gradient(E.simplify(e), at, 2)
    for a, b in zip(exact, finite_difference(lambda v: E.evaluate(e, v), at), strict=True):
        assert math.isclose(a, b, rel_tol=1e-3, abs_tol=1e-3)


def test_column_is_the_value(spark):
    env = [(1.5, 2.0), (None, 2.0), (2.0, None), (-1.0, 0.0), (0.0, 4.0)]
    trees = [KERNEL, X / Y, E.min_(X, Y), E.or_(X, Y), E.sqrt(X), E.powi(X, -2), E.select(E.gt(E.or_(X, 0), 1.0), X, Y), E.exp(Y), E.present(X), E.sum_(X, Y, 1)]
    df = spark.createDataFrame(env, "a double, b double")
    got = df.select(*[E.to_column(t, [df.a, df.b]).alias(f"t{i}") for i, t in enumerate(trees)]).collect()
    for row, values in zip(got, env, strict=True):
        for t, v in zip(trees, row, strict=True):
            want = E.evaluate(t, values)
            assert v == want or math.isclose(v, want), (E.infix(t), values)
