"""Dense kernels on numpy arrays; everything here runs on blocks of bounded size."""

from __future__ import annotations

import numpy as np


def signs(diagonal: np.ndarray) -> np.ndarray:
    """+1 or -1 for each entry; 0 counts as positive."""
    return np.where(diagonal < 0, -1.0, 1.0)


def thin_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q (m x n) and R (n x n) with A = QR; with fewer rows than columns both are padded with zeros."""
    m, n = a.shape
    q, r = np.linalg.qr(a, mode="reduced")
    if m < n:
        q = np.hstack([q, np.zeros((m, n - m))])
        r = np.vstack([r, np.zeros((n - m, n))])
    return q, r


def canonical(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(d, d R) with a diagonal of R that is not negative; d are the signs taken out."""
    d = signs(np.diag(r))
    return d, d[:, None] * r + 0.0


def multiply(a: np.ndarray, b: np.ndarray, a_transposed: bool = False, b_transposed: bool = False) -> np.ndarray:
    """op(A) op(B), each as it is or transposed."""
    return (a.T if a_transposed else a) @ (b.T if b_transposed else b)


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, largest first, and their vectors as columns."""
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("an eigenproblem needs a square matrix")
    w, v = np.linalg.eigh((a + a.T) / 2)
    return w[::-1], v[:, ::-1]


def general_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and right eigenvectors of a square matrix, by descending real part."""
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("an eigenproblem needs a square matrix")
    w, v = np.linalg.eig(a)
    order = np.argsort(-w.real, kind="stable")
    return w[order], v[:, order]


def pack_upper(a: np.ndarray) -> np.ndarray:
    """The upper triangle by rows."""
    return a[np.triu_indices(len(a))]


def unpack_upper(packed: np.ndarray) -> np.ndarray:
    """The symmetric matrix of a packed upper triangle; its order follows from the length."""
    n = int((np.sqrt(8 * len(packed) + 1) - 1) / 2)
    if n * (n + 1) // 2 != len(packed):
        raise ValueError(f"{len(packed)} values are no upper triangle")
    a = np.zeros((n, n))
    a[np.triu_indices(n)] = packed
    return np.triu(a) + np.triu(a, 1).T
