"""A Spark-native analytics engine for RDF data kept as relational tables."""
