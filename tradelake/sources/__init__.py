"""Readers producing the raw archive layer."""
