"""Part of the tallyspark engine."""
