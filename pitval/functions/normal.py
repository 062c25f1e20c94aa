"""Standard normal distribution as Spark expressions and over numpy arrays."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# ---- fixed values: coefficients of Hart's rational approximation (double precision) ----
TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
       221.213596169931, 220.206867912376)
BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
          637.333633378831, 793.826512519948, 440.413735824752)
NEAR = 7.07106781186547
FAR = 37.0
ROOT_TWO_PI = 2.506628274631


def _poly(x, coefficients):
    acc = coefficients[0]
    for c in coefficients[1:]:
        acc = acc * x + c
    return acc


def _poly_col(x: Column, coefficients) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def cdf(z: Column) -> Column:
    """Distribution function. The lambda keeps the generated code small and evaluates ``z`` once:
    spelled out in place, a handful of these outgrow what the JVM compiles."""
    return F.element_at(F.transform(F.array(z), _cdf), 1)


def _cdf(z: Column) -> Column:
    x = F.abs(z)
    e = F.exp(-x * x / 2)
    tail = x + 1.0 / (x + 2.0 / (x + 3.0 / (x + 4.0 / (x + 0.65))))
    upper = (F.when(x > FAR, F.lit(0.0))
             .when(x < NEAR, e * _poly_col(x, TOP) / _poly_col(x, BOTTOM)).otherwise(e / tail / ROOT_TWO_PI))
    return F.when(z > 0, 1.0 - upper).otherwise(upper)


def pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def cdf_array(z: np.ndarray) -> np.ndarray:
    x = np.abs(z)
    e = np.exp(-x * x / 2)
    near = e * _poly(np.minimum(x, NEAR), TOP) / _poly(np.minimum(x, NEAR), BOTTOM)
    tail = x + 1.0 / (x + 2.0 / (x + 3.0 / (x + 4.0 / (x + 0.65))))
    upper = np.where(x > FAR, 0.0, np.where(x < NEAR, near, e / tail / ROOT_TWO_PI))
    return np.where(z > 0, 1.0 - upper, upper)


def cdf_sql(z: str) -> str:
    """The same function as SQL text, for an engine without an error function."""
    def poly(coefficients):
        acc = f"CAST({coefficients[0]!r} AS DOUBLE)"
        for c in coefficients[1:]:
            acc = f"({acc} * abs({z}) + CAST({c!r} AS DOUBLE))"
        return acc
    x = f"abs({z})"
    tail = f"({x} + 1.0 / ({x} + 2.0 / ({x} + 3.0 / ({x} + 4.0 / ({x} + 0.65)))))"
    e = f"exp(-{x} * {x} / 2)"
    upper = (f"CASE WHEN {x} > 37 THEN 0 WHEN {x} < {NEAR} THEN {e} * {poly(TOP)} / {poly(BOTTOM)} "
             f"ELSE {e} / {tail} / {ROOT_TWO_PI} END")
    return f"(CASE WHEN {z} > 0 THEN 1 - ({upper}) ELSE ({upper}) END)"
