"""tabletidy: data-quality profiling and cleaning as native Spark jobs."""

from tabletidy.operators.profile import profile, profile_approx, profile_rows
from tabletidy.plans.cleaning import CleaningPlan, clean, fit, fit_transform, transform

__all__ = ["CleaningPlan", "clean", "fit", "fit_transform", "profile", "profile_approx", "profile_rows", "transform"]
