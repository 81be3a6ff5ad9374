"""auditframe: a PySpark-native engine for model-evaluation analytics and dataset audits."""
