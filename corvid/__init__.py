"""Spark-native e-mail forensics and text-corpus analytics."""
