"""Column-level building blocks: cleaning, roles and scalar functions."""
