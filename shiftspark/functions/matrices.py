"""Small matrices on the driver or within a task."""

from __future__ import annotations

import math

import numpy as np


def nearest_psd(a: np.ndarray, floor: float = 1e-9) -> np.ndarray:
    """The symmetric part of a with eigenvalues of at least ``floor`` times the largest (or times 1)."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    return (vectors * np.maximum(values, floor * max(1.0, float(values.max(initial=0.0))))) @ vectors.T


def logdet_inverse(a: np.ndarray, floor: float = 1e-9) -> tuple[float, np.ndarray]:
    """(log determinant, inverse) by Cholesky, of the nearest positive definite matrix where a is none."""
    try:
        root = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        root = np.linalg.cholesky(nearest_psd(a, floor))
    half = np.linalg.solve(root, np.eye(len(a)))
    return 2 * float(np.log(np.diag(root)).sum()), half.T @ half


def squared_mahalanobis(x: np.ndarray, mean: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Squared distances of rows from a mean under covariance a."""
    d = np.atleast_2d(x) - mean
    return np.einsum("ij,jk,ik->i", d, logdet_inverse(a)[1], d)


def random_orthogonal(n: int, seed: int = 0) -> np.ndarray:
    """Uniform over orthogonal matrices: QR with the signs of R's diagonal taken out."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def exp_or_inf(x: float) -> float:
    """exp, infinite where it overflows; NaN is an error."""
    if math.isnan(x):
        raise ValueError("exp of NaN")
    return math.inf if x > 709.782712893384 else math.exp(x)
