"""Spark-native fusion of spatial evidence about structures along rivers."""
