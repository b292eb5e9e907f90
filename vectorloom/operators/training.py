"""Driver-side parts of perceptron training: optimisers and per-epoch decisions.

They see one weight vector or one number per epoch, never rows.
"""

from __future__ import annotations

import numpy as np


class Adam:
    def __init__(self, rate: float, beta1: float = 0.9, beta2: float = 0.999, tiny: float = 1e-8):
        self.rate, self.beta1, self.beta2, self.tiny = rate, beta1, beta2, tiny
        self.steps, self.mean, self.square = 0, 0.0, 0.0

    def update(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.mean = self.beta1 * self.mean + (1 - self.beta1) * gradient
        self.square = self.beta2 * self.square + (1 - self.beta2) * gradient**2
        scale = np.sqrt(1 - self.beta2**self.steps) / (1 - self.beta1**self.steps)
        return weights - self.rate * scale * self.mean / (np.sqrt(self.square) + self.tiny)


class Sgd:
    """Gradient descent with momentum, optionally Nesterov's, and inverse-time decay."""

    def __init__(self, rate: float, momentum: float = 0.0, decay: float = 0.0, nesterov: bool = False):
        self.rate, self.momentum, self.decay, self.nesterov = rate, momentum, decay, nesterov
        self.steps, self.velocity = 0, 0.0

    def update(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        pull = -self.rate / (1 + self.decay * self.steps) * gradient
        self.steps += 1
        self.velocity = self.momentum * self.velocity + pull
        return weights + (self.momentum * self.velocity + pull if self.nesterov else self.velocity)


class EarlyStop:
    """True from `seen` once the loss has not improved for `patience` epochs in a row."""

    def __init__(self, patience: int):
        self.patience, self.best, self.idle = patience, np.inf, 0

    def seen(self, loss: float) -> bool:
        if loss < self.best:
            self.best, self.idle = loss, 0
            return False
        self.idle += 1
        return self.idle >= self.patience


class BestWeights:
    """Keeps the weights of the epoch with the lowest loss; `seen` tells whether it is a new best."""

    def __init__(self):
        self.loss, self.epoch, self.weights = np.inf, None, None

    def seen(self, epoch: int, loss: float, weights: np.ndarray) -> bool:
        if loss >= self.loss:
            return False
        self.loss, self.epoch, self.weights = loss, epoch, weights
        return True


class Plateau:
    """Lowers a learning rate when accuracy has not risen for `patience` epochs."""

    def __init__(self, patience: int, factor: float = 0.5, floor: float = 1e-4, least_gain: float = 1e-4):
        self.patience, self.factor, self.floor, self.least_gain = patience, factor, floor, least_gain
        self.best, self.idle = -np.inf, 0

    def rate_after(self, accuracy: float, rate: float) -> float:
        if accuracy > self.best + self.least_gain:
            self.best, self.idle = accuracy, 0
            return rate
        self.idle += 1
        if self.idle < self.patience:
            return rate
        self.idle = 0
        return max(rate * self.factor, self.floor) if rate > self.floor else rate
