"""feedspark: editorial feed processing as Spark DataFrame operators."""
