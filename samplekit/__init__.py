"""Spark-native curation of labelled samples and evaluation of binary detectors."""
