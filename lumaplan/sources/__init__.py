"""Planes, packets and streams as DataFrames."""
