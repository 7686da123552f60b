"""ledgerlens: a PySpark-native analytics engine for public-budget line items."""
