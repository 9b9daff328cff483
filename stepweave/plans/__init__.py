"""The registered queries and their SQL."""

from stepweave.plans import catalogue, figures, labelling, reporting  # each registers its queries

__all__ = ["catalogue", "figures", "labelling", "reporting"]
