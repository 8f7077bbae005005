"""Projection-predictive feature selection and model evaluation on Spark."""
