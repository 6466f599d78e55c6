"""Plane codec operators: entropy coders, headers, slices, frames, and their DataFrame forms."""
