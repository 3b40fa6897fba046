"""A Spark-native relational engine with explicit types, and operators for large text corpora."""
