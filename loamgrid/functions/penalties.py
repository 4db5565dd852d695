"""Penalties of one coefficient: soft threshold, SCAD and MCP, and exact one-dimensional minima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GAMMA = {"scad": 3.7, "mcp": 3.0}


def soft_threshold(z: Column, t: Column) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - t, F.lit(0.0))


def soft(z: np.ndarray, t: float | np.ndarray) -> np.ndarray:
    return np.sign(z) * np.maximum(np.abs(z) - t, 0)


def check_gamma(penalty: str, gamma: float | None) -> float:
    gamma = GAMMA[penalty] if gamma is None else float(gamma)
    if gamma <= (2 if penalty == "scad" else 1):
        raise ValueError(f"gamma of {penalty} must be above {2 if penalty == 'scad' else 1}")
    return gamma


def penalty_value(b: np.ndarray, lam: float, gamma: float, penalty: str) -> np.ndarray:
    t = np.abs(b)
    if penalty == "mcp":
        return np.where(t <= gamma * lam, lam * t - t * t / (2 * gamma), gamma * lam * lam / 2)
    middle = (2 * gamma * lam * t - t * t - lam * lam) / (2 * (gamma - 1))
    return np.where(t <= lam, lam * t, np.where(t <= gamma * lam, middle, lam * lam * (gamma + 1) / 2))


def penalty_column(b: Column, lam: float, gamma: float, penalty: str) -> Column:
    t = F.abs(b)
    if penalty == "mcp":
        return F.when(t <= gamma * lam, lam * t - t * t / (2 * gamma)).otherwise(gamma * lam * lam / 2)
    middle = (2 * gamma * lam * t - t * t - lam * lam) / (2 * (gamma - 1))
    return F.when(t <= lam, lam * t).when(t <= gamma * lam, middle).otherwise(lam * lam * (gamma + 1) / 2)


def penalty_slope(b: np.ndarray, lam: float, gamma: float, penalty: str) -> np.ndarray:
    """First derivative in the size of the coefficient."""
    t = np.abs(b)
    if penalty == "mcp":
        return np.maximum(lam - t / gamma, 0)
    return np.where(t <= lam, lam, np.maximum(gamma * lam - t, 0) / (gamma - 1))


def penalty_curvature(b: np.ndarray, lam: float, gamma: float, penalty: str) -> np.ndarray:
    """Second derivative inside each piece."""
    t = np.abs(b)
    if penalty == "mcp":
        return np.where((t > 0) & (t < gamma * lam), -1 / gamma, 0.0)
    return np.where((t > lam) & (t < gamma * lam), -1 / (gamma - 1), 0.0)


def exact_minimum(z: np.ndarray, g: np.ndarray, lam: float | np.ndarray, gamma: float, penalty: str) -> np.ndarray:
    """Minimiser of ``g b^2 / 2 - z b + penalty(b)``; of equal values the smaller size.

    Each piece of the penalty is a parabola: its vertex, clipped to the piece,
    and the ends of the pieces are all the places a minimum can be.
    """
    a, top = np.abs(z), gamma * lam
    with np.errstate(divide="ignore", invalid="ignore"):
        free = np.maximum(np.where(g > 0, a / g, top), top)
        if penalty == "mcp":
            h = g - 1 / gamma
            found = [np.clip(np.where(h > 0, (a - lam) / h, 0), 0, top), np.full_like(a, top), free]
        else:
            h = g - 1 / (gamma - 1)
            first = np.clip(np.where(g > 0, (a - lam) / g, lam), 0, lam)
            second = np.clip(np.where(h > 0, (a - top / (gamma - 1)) / h, lam), lam, top)
            found = [first, np.full_like(a, lam), second, np.full_like(a, top), free]
    best, value = np.zeros_like(a), np.zeros_like(a)
    for b in found:
        now = 0.5 * g * b * b - a * b + penalty_value(b, lam, gamma, penalty)
        better = now < value - 1e-14 * (1 + np.abs(value))
        best, value = np.where(better, b, best), np.where(better, now, value)
    return np.sign(z) * best
