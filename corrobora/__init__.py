"""corrobora: reconciliation of noisy readings, and corpus operators, on Spark."""
