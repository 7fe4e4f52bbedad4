"""Panel analytics on Spark: DataFrame operators over ``(symbol, date)`` panels."""
