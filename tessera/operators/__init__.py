"""Operators: profiling, cleaning, imputation, splitting, features, models,
evaluation and interpretation. Each is a DataFrame function or a Spark ML stage."""
