"""Record readiness and reconciliation as DataFrame operators.

Every operator takes DataFrames and returns a DataFrame. Nothing here collects
rows to the driver; the physical plan is left to Catalyst and AQE.
"""

from greenlight.settings import Settings

__all__ = ["Settings"]
