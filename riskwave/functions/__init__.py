from riskwave.functions.features import (
    engineer_features, fill_missing, geo_mismatch, velocity_band, monitor_band,
    risk_level, decision_label, CAT_COLS, FEATURE_COLS, NUM_COLS,
)

__all__ = ["engineer_features", "fill_missing", "geo_mismatch", "velocity_band",
           "monitor_band", "risk_level", "decision_label", "CAT_COLS",
           "FEATURE_COLS", "NUM_COLS"]
