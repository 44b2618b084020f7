"""State contrast, drift detection and alert triage as PySpark DataFrame operators."""
