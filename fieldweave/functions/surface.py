"""Wind, aviation, convection and flux formulas on columns; a null input gives null unless a function says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldweave.functions.thermo import CPD, LV, RD, finite

#: Fixed thresholds: visibility in km, cloud base in kilofeet.
VISIBILITY_STATES = (8.0, 5.0, 3.7, 2.5, 1.6, 0.8)
CLOUD_STATES = (2.5, 1.5, 0.7, 0.5, 0.3, 0.2)


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees from north that the wind blows from, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360, F.lit(360.0))


def beaufort(speed: Column) -> Column:
    """Beaufort force of a speed in m s-1, halves to the even number."""
    return F.rint(F.pow(speed / 0.836, F.lit(2 / 3)))


def states_below(value: Column, thresholds: tuple[float, ...]) -> Column:
    return reduce(lambda a, b: a + b, ((value < t).cast("int") for t in thresholds))


def visibility_state(visibility_km: Column) -> Column:
    return states_below(visibility_km, VISIBILITY_STATES)


def cloud_base_state(base_kilofeet: Column, orography_kilofeet: Column | None = None) -> Column:
    """The state of a cloud base above ground; no cloud base is the best state, 0."""
    above = base_kilofeet if orography_kilofeet is None else base_kilofeet - orography_kilofeet
    return F.coalesce(states_below(above, CLOUD_STATES), F.lit(0))


def colour_state(visibility: Column, cloud: Column) -> Column:
    """The worse of two states; null if either is."""
    return F.when(visibility.isNotNull() & cloud.isNotNull(), F.greatest(visibility, cloud))


def cape_ratio(surface_cape: Column, unstable_cape: Column, inhibition: Column, threshold: float = -75.0) -> Column:
    return F.when(inhibition > threshold, finite(1 - F.try_divide(surface_cape, unstable_cape)))


def inflow_layer(base: Column, layer_height: Column, orography: Column) -> Column:
    """1 where the inflow layer's base is above the boundary layer over ground, else 0, missing values included."""
    return F.coalesce((base > layer_height + orography).cast("int"), F.lit(0))


def sensible_heat_flux(covariance: Column, temperature: Column, pressure_pa: Column) -> Column:
    return F.try_divide(CPD * pressure_pa, RD * temperature) * covariance


def latent_heat(value: Column, units: Column) -> Column:
    """W m-2 from kg m-2 s-1; values in other units pass as they are."""
    return F.when(units == "kg m-2 s-1", value * LV).otherwise(value)


def latent_heat_unit(units: Column) -> Column:
    return F.when(units == "kg m-2 s-1", F.lit("W m-2")).otherwise(units)
