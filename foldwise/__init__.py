"""Fold-based regression evaluation as Spark DataFrame jobs.

The fold, the split role, the model and the parameter key are columns, so one
job covers every fold and every model; no driver loop walks over folds to
compute statistics, weights, scalers or metrics.
"""

__version__ = "0.1.0"
