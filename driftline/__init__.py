"""Spark-native revision-diff analytics: diff, match, cluster, score and report as lazy DataFrame plans."""
