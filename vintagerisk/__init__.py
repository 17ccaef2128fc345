"""Point-in-time credit-risk analytics as PySpark DataFrame operators."""
