"""Longitudinal cohort analytics and risk-model validation on Spark DataFrames."""
