"""Subgroup-aware survival analytics on Spark DataFrames."""

from mixhaz.operators.scaling import InputError
from mixhaz.plans.engine import Control, Settings
from mixhaz.plans.fitting import cross_validate, final_model, fit_mixture, fit_model, run_cv
from mixhaz.plans.gated import fit_gated
from mixhaz.plans.heatmap import beta_heatmap
from mixhaz.plans.inference import heterogeneity_test, permutation_test, sequential_k
from mixhaz.plans.model import GuardWarning, MixtureModel, NotConvergedWarning
from mixhaz.sources.readers import read_data

__all__ = ["Control", "GuardWarning", "InputError", "MixtureModel", "NotConvergedWarning", "Settings", "beta_heatmap",
           "cross_validate", "final_model", "fit_gated", "fit_mixture", "fit_model", "heterogeneity_test", "permutation_test",
           "read_data", "run_cv", "sequential_k"]
