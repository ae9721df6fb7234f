"""Pressure, humidity and temperature formulas on columns.

Temperatures in K, pressures in hPa, mixing ratios and humidities in kg kg-1, relative
humidity as a fraction unless a name says percent. A null input gives null, as does a
division by zero or a value outside a formula's range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
P0 = 1000.0
RD = 287.05
RV = 461.52
CPD = 1005.0
LV = 2.501e6
E0 = 6.1121
T0 = 273.15
EPSILON = 0.62197
KAPPA = RD / CPD


def finite(value: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def within(value: Column, judged: Column, low: float, high: float) -> Column:
    return F.when((judged >= low) & (judged <= high), value)


def vapour_pressure(t: Column) -> Column:
    c = t - T0
    return E0 * F.exp(F.try_divide(17.502 * c, 240.97 + c))


def vapour_pressure_from_rh(t: Column, rh: Column) -> Column:
    return vapour_pressure(t) * rh


def exner_pressure(p: Column) -> Column:
    return F.pow(p / P0, F.lit(KAPPA))


def mixing_ratio_from_specific_humidity(q: Column) -> Column:
    return F.try_divide(q, 1 - q)


def specific_humidity_from_mixing_ratio(w: Column) -> Column:
    return F.try_divide(w, 1 + w)


def saturation_mixing_ratio(t: Column, p: Column) -> Column:
    e = vapour_pressure(t)
    return F.try_divide(EPSILON * e, p - e)


def saturation_specific_humidity(t: Column, p: Column) -> Column:
    return F.try_divide(EPSILON * vapour_pressure(t), p)


def mixing_ratio_from_rh(t: Column, p: Column, rh: Column) -> Column:
    return saturation_mixing_ratio(t, p) * rh


def specific_humidity_from_rh(t: Column, p: Column, rh: Column) -> Column:
    return saturation_specific_humidity(t, p) * rh


def rh_percent_from_mixing_ratio(w: Column, t: Column, p: Column) -> Column:
    return 100 * F.try_divide(w, saturation_mixing_ratio(t, p))


def rh_percent_from_specific_humidity(q: Column, t: Column, p: Column) -> Column:
    return 100 * F.try_divide(q, saturation_specific_humidity(t, p))


def dewpoint_temperature(t: Column, rh: Column) -> Column:
    log_e = F.log(vapour_pressure_from_rh(t, rh))
    dewpoint = F.try_divide(243.5 * log_e - 440.8, 19.48 - log_e) + T0
    return within(dewpoint, t - T0, -35, 35)


def virtual_temperature(t: Column, w: Column) -> Column:
    return F.try_divide(t * (w + EPSILON), EPSILON * (1 + w))


def wet_bulb_temperature(t: Column, rh_percent: Column) -> Column:
    c, r = t - T0, rh_percent
    wet = (
        c * F.atan(0.151977 * F.sqrt(r + 8.313659))
        + F.atan(c + r)
        - F.atan(r - 1.676331)
        + 0.00391838 * F.pow(r, F.lit(1.5)) * F.atan(0.023101 * r)
        - 4.686035
    )
    return within(within(wet + T0, c, -20, 50), r, 5, 99)


def potential_temperature(t: Column, p: Column) -> Column:
    return F.try_divide(t, exner_pressure(p))


def virtual_potential_temperature(t: Column, w: Column, p: Column) -> Column:
    return F.try_divide(virtual_temperature(t, w), exner_pressure(p))


def equivalent_potential_temperature(t: Column, rh: Column, p: Column) -> Column:
    w = mixing_ratio_from_rh(t, p, rh)
    return potential_temperature(t, p) * F.pow(rh, -w * RV / CPD) * F.exp(F.try_divide(LV * w, CPD * t))


def wet_bulb_potential_temperature(t: Column, rh: Column, p: Column) -> Column:
    return wet_bulb_of_equivalent(equivalent_potential_temperature(t, rh, p))


def wet_bulb_of_equivalent(theta: Column) -> Column:
    """The wet-bulb potential temperature of an equivalent one; given as a column, it is computed once, not at each of its many places."""
    x = theta / T0
    # Fixed coefficients, of rising powers of x.
    above = (7.101574, -20.68208, 16.11182, 2.574631, -5.205688)
    below = (1.0, -3.552497, 3.781782, -0.6899655, -0.5929340)

    def polynomial(coefficients: tuple[float, ...]) -> Column:
        total = F.lit(0.0)
        for c in reversed(coefficients):
            total = total * x + c
        return total

    wet = theta - F.exp(F.try_divide(polynomial(above), polynomial(below)))
    return within(wet, wet - T0, -30, 50)


def saturation_equivalent_potential_temperature(t: Column, p: Column) -> Column:
    return potential_temperature(t, p) * F.exp(F.try_divide(LV * saturation_mixing_ratio(t, p), CPD * t))
