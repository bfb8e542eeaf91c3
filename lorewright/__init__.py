"""lorewright: a Spark-native biographical knowledge-graph analytics engine."""
