"""Spark ML plans: fit, tune, evaluate and the end-to-end rating pipeline."""
