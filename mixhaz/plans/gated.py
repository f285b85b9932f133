"""The comparison model: membership by a logistic gate on the features instead of a Gaussian mixture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from mixhaz.plans.fitting import fit_mixture
from mixhaz.plans.model import MixtureModel


def fit_gated(df: DataFrame, cluster_vars: Sequence[str], hazard_vars: Sequence[str] | None = None, k: int = 2,
              lam: float = 0.05, lambda_gate: float | None = None, gate_slopes: bool = True, **options) -> MixtureModel:
    """Latent-class hazards with P(Z = k | x) = softmax(a_k0 + a_k'x).

    Shares baselines, hazard updates, starts and stopping rule with `fit_mixture`. The
    model also carries the penalised objective, which EM increases.
    """
    return fit_mixture(df, cluster_vars, hazard_vars, k=k, lam=lam, prior="gate", lam_gate=lambda_gate,
                       gate_slopes=gate_slopes, **options)


def gate_slopes(model: MixtureModel):
    """Gate slopes per original feature unit (features x clusters)."""
    return model.gate[1:] / model.cluster_scaler[1][:, None]
