"""Operators for preparing training data, each applied to whole tables."""
