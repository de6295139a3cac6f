"""tallyspark: sales-audit analytics written with the Spark DataFrame API."""
