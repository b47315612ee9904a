"""Course enrollment and seat-capacity analytics on Spark DataFrames."""

from coursegrid.plans.registrar import Registrar

__all__ = ["Registrar"]
