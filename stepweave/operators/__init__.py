"""Operators on tables of steps, slices, patterns and labels."""
