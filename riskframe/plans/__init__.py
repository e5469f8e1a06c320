"""Multi-step jobs: cross-validation, model panels, parameter search, packaging."""
