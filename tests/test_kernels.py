import random
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galvana.functions import kernels
from galvana.operators import physics
from galvana.operators.config import Features, Ica


def brute_assign(reference, current):
    """Least total distance by trying all ways."""
    a, b = (reference, current) if len(reference) <= len(current) else (current, reference)
    return min(sum(abs(x - y) for x, y in zip(a, p, strict=True)) for s in combinations(b, len(a)) for p in permutations(s))


def test_config_hashes():
    assert Features().hash() == "a2e8f82ac14f9b7c"
    assert len(Ica().hash()) == 12 and Ica(dv_mv=1.0).hash() != Ica().hash()
    assert Features().grid_points == 341
    for bad in ({"sg_window": 20}, {"sg_polyorder": 21}, {"half_cycle": "rest"}):
        with pytest.raises(ValueError):
            Features(**bad)


def test_simpson():
    x = np.linspace(0, np.pi, 201)
    assert abs(kernels.simpson(np.sin(x), x) - 2) < 1e-6
    x = np.linspace(0, 1, 6)
    assert abs(kernels.simpson(x**2, x) - 1 / 3) < 1e-12
    x = np.array([0.0, 0.1, 0.35, 0.5, 0.8, 1.0])
    assert abs(kernels.simpson(x**2, x) - 1 / 3) < 1e-12


def test_pchip_is_monotone_and_exact_on_lines():
    x = np.array([0.0, 1, 2, 4, 5])
    assert np.allclose(kernels.pchip(x, 3 * x + 1, np.linspace(0, 5, 31), False), 3 * np.linspace(0, 5, 31) + 1)
    y = np.array([0.0, 0, 1, 1, 5])
    fine = kernels.pchip(x, y, np.linspace(0, 5, 501), False)
    assert (np.diff(fine) >= -1e-12).all() and np.isnan(kernels.pchip(x, y, np.array([-0.1, 5.1]), False)).all()


def test_savgol_keeps_cubics_everywhere():
    x = np.arange(60) * 0.1
    y = x**3 - 2 * x + 1
    assert np.allclose(kernels.savgol(y, 21, 3), y)
    assert np.allclose(kernels.savgol(y, 21, 3, 1, 0.1), 3 * x * x - 2)


@given(st.lists(st.floats(0.1, 5), min_size=2, max_size=40), st.integers(5, 9))
@settings(max_examples=50, deadline=None)
def test_rolling_cv(values, window):
    s = pd.Series(values)
    roll = s.rolling(window, center=True, min_periods=1)
    want = roll.std().fillna(0) / roll.mean().clip(lower=1e-12)
    assert np.allclose(kernels.rolling_cv(s.to_numpy(), window), want, atol=1e-7)


@pytest.mark.parametrize("spacing", [2.5, 5.0, 10.0])
def test_peak_widths_do_not_depend_on_the_grid(spacing):
    v = np.arange(3.0, 4.0, spacing / 1000)
    peak = lambda w: np.exp(-0.5 * ((v - 3.5) / w) ** 2)
    (a,), (b,) = physics.peaks_of(v, peak(0.05)), physics.peaks_of(v, peak(0.07))
    assert abs(a["width_mv"] - 2 * 50 * np.sqrt(2 * np.log(2))) < 1
    assert abs(physics.resistance_growth([a["width_mv"]], [b["width_mv"]]) - 0.4) < 0.05


def test_plateaus_and_prominence():
    y = np.array([0, 1, 3, 3, 3, 1, 2, 1.9, 0])
    assert kernels.find_peaks(y, 0.5)[0].tolist() == [3, 6]
    assert kernels.find_peaks(y, 1.5)[0].tolist() == [3]
    assert kernels.find_peaks(np.zeros(5), 0.1)[0].tolist() == []


def test_assignment_is_optimal():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.uniform(3, 4) for _ in range(rng.randint(0, 5))] for _ in range(2))
        got = sum(abs(a[i] - b[j]) for i, j in kernels.assign(np.array(a), np.array(b)))
        assert abs(got - (brute_assign(a, b) if a and b else 0)) < 1e-12


@pytest.mark.parametrize(
    ("reference", "current", "shifts", "lost", "new"),
    [
        ([3.50, 3.55], [3.515, 3.565], [0.015, 0.015], 0, 0),
        ([3.50, 3.51], [3.505], [-0.005], 1, 0),
        ([3.50, 3.70], [3.51, 3.69], [0.01, -0.01], 0, 0),
        ([3.5], [3.6], [], 1, 1),
        ([], [3.6], [], 0, 1),
    ],
)
def test_matching(reference, current, shifts, lost, new):
    found = physics.matched_peaks(np.array(reference), np.array(current))
    assert [round(abs(m["shift"]), 6) for m in found if m["matched"]] == [abs(s) for s in shifts]
    assert sum(m["disappeared"] for m in found) == lost
    assert sum(not m["matched"] and not m["disappeared"] for m in found) == new


@pytest.mark.parametrize(("share", "loss"), [(1, 0), (0.5, 0.5), (0, 1), (0.75, 0.25)])
def test_active_material_loss(share, loss):
    x = np.linspace(0, np.pi, 200)
    assert abs(physics.active_material_loss(x, np.sin(x), share * np.sin(x)) - loss) < 1e-6


def test_widths_must_be_positive():
    with pytest.raises(ValueError):
        physics.resistance_growth([0.0], [1.0])
    with pytest.raises(ValueError):
        physics.grid_spacing(np.array([1, 2, 4.0]))
