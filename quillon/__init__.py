"""Analytics on transaction-level sales data, as Spark DataFrame and SQL plans."""
