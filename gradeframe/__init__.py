"""Evaluation of sampled model outputs as Spark DataFrame transformations."""
