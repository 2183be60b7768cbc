"""Helpers that shape physical plans: checkpoints, salted joins, size-checked broadcasts."""
