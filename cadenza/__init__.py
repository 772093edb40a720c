"""Cadenza: speech-markup analytics as Spark DataFrame operators."""
