"""Tidemark: a PySpark-native market-screening analytics engine."""
