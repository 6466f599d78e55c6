"""Lossless plane coding and residual analytics on Spark."""
