"""Spark-native selection and preparation of language-model training data."""
