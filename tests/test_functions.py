import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skinnyla.functions import hashing, kernels
from skinnyla.plans import planner


def test_random_matrix_has_its_fixed_values():
    w = hashing.omega(2, 3)
    assert w[0] == pytest.approx([-0.36590893223550724, -0.4653774265404725, 0.016055348482607583], abs=1e-16)
    assert w[1] == pytest.approx([0.1625392524842024, 0.3604503283510418, -0.4922463906927751], abs=1e-16)


@given(st.integers(-(2**63), 2**63 - 1), st.integers(-(2**63), 2**63 - 1))
@settings(deadline=None)
def test_word_hash_is_the_byte_hash_of_eight_bytes(value, seed):
    assert int(hashing.murmur64(value, seed)[0]) == hashing.murmur64_bytes(value.to_bytes(8, "big", signed=True), seed)


@given(st.integers(0, 12), st.integers(1, 5), st.integers(0, 10**6))
@settings(deadline=None)
def test_thin_qr(m, n, seed):
    a = np.random.default_rng(seed).integers(-5, 6, (m, n)).astype(float)
    q, r = kernels.thin_qr(a)
    assert q.shape == (m, n) and r.shape == (n, n) and np.allclose(q @ r, a) and np.allclose(r, np.triu(r))
    d, c = kernels.canonical(r)
    assert (np.diag(c) >= 0).all() and np.allclose((q * d) @ c, a)


def test_eigen_and_packing():
    a = np.array([[2.0, 1.0], [1.0, 2.0]])
    w, v = kernels.symmetric_eigen(a)
    assert w == pytest.approx([3, 1]) and np.allclose(a @ v, v * w)
    assert kernels.general_eigen(a)[0] == pytest.approx([3, 1])
    assert (kernels.unpack_upper(kernels.pack_upper(a)) == a).all()
    for wrong in (np.zeros((2, 3)), np.zeros(3)):
        with pytest.raises(ValueError):
            kernels.symmetric_eigen(wrong)
    with pytest.raises(ValueError):
        kernels.unpack_upper(np.zeros(4))
    assert (kernels.multiply(a, np.ones((2, 3)), True) == a.T @ np.ones((2, 3))).all()


def test_planner():
    assert planner.check_sub_rows(None, 5) == 5 and planner.check_sub_rows(1 << 22, 4, 64) == (1 << 20)
    with pytest.raises(ValueError):
        planner.check_sub_rows(3, 5)
    assert planner.parse_schedule("4,1") == [4, 1] and planner.parse_schedule(None) is None
    for wrong in ("4", "", "0,1", [2]):
        with pytest.raises(ValueError):
            planner.parse_schedule(wrong)
    assert planner.schedule_for(3, 5) == [1] and planner.schedule_for(10_000, 5) == [157, 3, 1]
    assert planner.map_tasks(65 << 20, 64) == 2 and planner.check_split(64, 1 << 45, 4096, 8) > 64


@given(st.lists(st.binary(max_size=40), max_size=20), st.integers(-(2**63), 2**63 - 1))
@settings(deadline=None)
def test_hashes_of_many_byte_strings(texts, seed):
    assert hashing.murmur64_texts(texts, seed).tolist() == [hashing.murmur64_bytes(x, seed) for x in texts]
