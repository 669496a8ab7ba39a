"""Parameters of the wear analytics, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults that results depend on. Steps of the clock search are in whole
    steps and seconds here; its spans are coarse_step_s * coarse_steps and fine_span_s."""

    power_min_kw: float = 0.0
    power_abs_max_kw: float = 500.0
    robust_outlier_iqr_multiple: float = 50.0
    drop_duplicate_readings: bool = True
    swap_reversed_job_times: bool = True
    impute_missing_quantity: bool = True
    min_job_duration_s: float = 1.0
    align_clocks: bool = True
    coarse_step_s: int = 3600
    coarse_steps: int = 14
    fine_step_s: int = 60
    fine_span_s: int = 3600
    pair_tolerance_s: float = 1.0
    job_edge_trim_s: float = 0.0
    idle_method: str = "min"
    idle_percentile: float = 5.0
    fallback_to_global: bool = True
    cutting_power_floor_kw: float = 0.5
    target: str = "log_vibration_rms_g"
    primary_model: str = "huber"
    sigma_multiple: float = 6.0
    one_sided: bool = True
    scale_estimator: str = "trimmed_mad"
    scale_trim_sigma: float = 3.0
    ridge_alpha: float = 1.0
    huber_epsilon: float = 1.35
    huber_rounds: int = 100
    ransac_trials: int = 120
    secondary_model: str = "mahalanobis"
    contamination: float = 0.15
    if_n_estimators: int = 100
    if_max_samples: int = 256
    lof_n_neighbors: int = 20
    lof_reference_size: int = 4000
    min_anomalous_readings: int = 5
    min_anomalous_fraction: float = 0.05
    min_readings_for_verdict: int = 20
    score_quantile: float = 0.95
    random_state: int = 7
    mode: str = "fit"
    #: "joint": Huber's loss over coefficients and scale together, least covariance determinant,
    #: local outlier factor over all rows. "iterated": reweighting, concentration steps, a
    #: reference sample of lof_reference_size rows.
    backend: str = "joint"
    #: For percentiles by machine, part or job. None: exact; else the accuracy of percentile_approx.
    quantile_accuracy: int | None = None

    def __post_init__(self):
        if not 0 < self.contamination < 0.5:
            raise ValueError("contamination must lie between 0 and 0.5")
        if self.sigma_multiple <= 0:
            raise ValueError("sigma_multiple must be positive")
        if not (0 < self.min_anomalous_fraction <= 1 and 0 < self.score_quantile <= 1):
            raise ValueError("fractions must lie in (0, 1]")
        choices = {
            "primary_model": ("ridge", "huber", "ransac", "robust"), "secondary_model": ("mahalanobis", "isolation_forest", "lof"),
            "scale_estimator": ("std", "iqr", "mad", "trimmed_mad"), "idle_method": ("min", "percentile"),
            "target": ("log_vibration_rms_g", "vibration_rms_g"), "mode": ("fit", "load"), "backend": ("joint", "iterated"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
