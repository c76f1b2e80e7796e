"""Iterative plans: tree construction, refinement, likelihood and placement."""
