"""Vellumflow: a PySpark-native analytics engine for transcribed-document corpora."""
