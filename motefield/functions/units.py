"""Unit systems as tables of factors to SI, and conversions as Columns."""

from __future__ import annotations

from pyspark.sql import Column

#: Exact or CODATA constants in SI units.
AVOGADRO, CHARGE, BOLTZMANN = 6.02214076e23, 1.602176634e-19, 1.380649e-23
DALTON, BOHR, HARTREE = 1e-3 / AVOGADRO, 5.29177210903e-11, 4.3597447222071e-18

#: Factors to SI of each system's units of mass, length, time, energy, charge and temperature.
SYSTEMS: dict[str, dict[str, float]] = {
    "real": {"mass": DALTON, "length": 1e-10, "time": 1e-15, "energy": 4184 / AVOGADRO, "charge": CHARGE, "temperature": 1.0},
    "metal": {"mass": DALTON, "length": 1e-10, "time": 1e-12, "energy": CHARGE, "charge": CHARGE, "temperature": 1.0},
    "si": {"mass": 1.0, "length": 1.0, "time": 1.0, "energy": 1.0, "charge": 1.0, "temperature": 1.0},
    "cgs": {"mass": 1e-3, "length": 1e-2, "time": 1.0, "energy": 1e-7, "charge": 3.3356409519815204e-10, "temperature": 1.0},
    "electron": {"mass": DALTON, "length": BOHR, "time": 1e-15, "energy": HARTREE, "charge": CHARGE, "temperature": 1.0},
    "micro": {"mass": 1e-15, "length": 1e-6, "time": 1e-6, "energy": 1e-15, "charge": 1e-12, "temperature": 1.0},
    "nano": {"mass": 1e-21, "length": 1e-9, "time": 1e-9, "energy": 1e-21, "charge": CHARGE, "temperature": 1.0},
}


def reduced(mass: float, sigma: float, epsilon: float) -> dict[str, float]:
    """The system of Lennard-Jones units of a mass in kg, a length in m and an energy in J."""
    return {"mass": mass, "length": sigma, "energy": epsilon, "time": sigma * (mass / epsilon) ** 0.5, "temperature": epsilon / BOLTZMANN}


def factor(quantity: str, source: str | dict[str, float], target: str | dict[str, float]) -> float:
    """What a number of ``quantity`` is multiplied by; derived ones are written ``length/time``
    or ``energy/length``."""
    a, b = (SYSTEMS[s] if isinstance(s, str) else s for s in (source, target))
    top, *below = quantity.split("/")
    out = a[top] / b[top]
    for q in below:
        out *= b[q] / a[q]
    return out


def convert(value: Column, quantity: str, source: str | dict[str, float], target: str | dict[str, float]) -> Column:
    return value * factor(quantity, source, target)
