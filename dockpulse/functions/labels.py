"""Readable names of the fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed labels.
PHYSICAL_CONFIGURATIONS = {
    "ELECTRICBIKESTATION": "Electric Bike Station",
    "REGULAR": "Regular",
    "REGULARLITMAPFRAME": "Regular Lit Map Frame",
    "SMARTLITMAPFRAME": "Smart Lit Map Frame",
    "SMARTMAPFRAME": "Smart Map Frame",
    "VAULT": "Vault",
}
ENDPOINTS = {
    "versions": "Versions",
    "vehicle_types": "Vehicle types",
    "station_information": "Station information",
    "station_status": "Station status",
    "system_information": "System information",
    "system_regions": "System regions",
    "system_pricing_plans": "System pricing plans",
}


def label(column: str, labels: dict[str, str], missing: str = "None") -> Column:
    """Label of a value compared as a whole; `missing` for null, null for a value without a label."""
    result = F.when(F.col(column).isNull(), missing)
    for value, text in labels.items():
        result = result.when(F.col(column) == value, text)
    return result
