"""Linear models for bounded samples: logistic regression on sparse presence
features, softmax regression and a linear support vector machine on dense rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, dims: int, *, l2: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the ``dims`` presence features, weights of the dense columns, intercept.

    Row ``rows[k]`` has feature ``cols[k]``. Accelerated gradient steps, each coordinate scaled by a bound
    of its curvature (a quarter of its values times its rows' sums), so no step size is searched. Labels
    of one class only give the constant of that class.
    """
    n, k = dense.shape
    share = y.mean() if n else 0.0
    if share in (0.0, 1.0):
        return np.zeros(dims), np.zeros(k), 8.0 if share else -8.0
    row_sum = np.bincount(rows, minlength=n) + np.abs(dense).sum(1) + 1
    bound = np.concatenate([np.bincount(cols, row_sum[rows], dims), np.abs(dense).T @ row_sum, [row_sum.sum()]])
    step = 1 / (0.25 * bound / n + l2)
    w = np.zeros(dims + k + 1)
    w[-1] = np.log(share / (1 - share))
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        z = np.bincount(rows, ahead[cols], n) + dense @ ahead[dims:-1] + ahead[-1]
        miss = (sigmoid(z) - y) / n
        grad = np.concatenate([np.bincount(cols, miss[rows], dims), dense.T @ miss, [miss.sum()]])
        grad[:-1] += l2 * ahead[:-1]
        new = ahead - step * grad
        if (ahead - new) @ (new - w) > 0:  # restart when momentum points uphill
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:dims], w[dims:-1], float(w[-1])


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, *, l2: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights (classes x columns + 1) of softmax regression; rows of ``x`` have length 1 at most."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros((classes, x.shape[1]), x.dtype)
    hit = np.eye(classes, dtype=x.dtype)[y]
    ahead, t, step = w.copy(), 1.0, 1.0
    for _ in range(rounds):
        z = x @ ahead.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - step * ((p - hit).T @ x / len(x) + l2 * ahead)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def fit_svm(x: np.ndarray, y: np.ndarray, *, c: float = 10.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights and bias of a linear SVM for labels -1 and 1 by dual coordinate descent (squared hinge)."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    diag = (x * x).sum(1) + 0.5 / c
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + 0.5 / c * alpha[i]
            new = max(0.0, alpha[i] - g / diag[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w
