"""Spark-native recall and corpus analytics over long documents."""
