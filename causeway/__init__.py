"""Accessibility-risk analytics on Spark: deterioration, network loss, policies, optimisation."""
