"""Distribution functions against known values; sequential rules against plain ones."""

import math

import pytest

from tickloom.functions import stats as S
from tickloom.operators.indicators import ewm


@pytest.mark.parametrize(("t", "df", "p"), [(2.228, 10, 0.05), (1.96, 1e6, 0.05), (0.0, 5, 1.0), (12.706, 1, 0.05)])
def test_student(t, df, p):
    assert S.t_two_sided(t, df) == pytest.approx(p, abs=2e-4)


def test_beta_quantile_inverts():
    for a, b, q in ((1, 1, 0.3), (3, 7, 0.025), (40, 2, 0.975)):
        assert S.incomplete_beta(a, b, S.beta_quantile(q, a, b)) == pytest.approx(q, abs=1e-9)


def test_normal():
    assert S.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert S.normal_two_sided(float("nan")) is None


def test_ewm_gate_and_nulls():
    out = ewm([1.0, 2.0, None, 4.0], 0.5, 2)
    assert out[0] is None and out[1] == 1.5 and out[2] == 1.5
    # The old mean's weight has decayed twice: (0.25 * 1.5 + 0.5 * 4) / 0.75.
    assert math.isclose(out[3], (0.25 * 1.5 + 0.5 * 4) / 0.75)
