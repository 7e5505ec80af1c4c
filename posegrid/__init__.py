"""Spark-native analytics over posed observations: tables in, instances, graphs and scores out."""
