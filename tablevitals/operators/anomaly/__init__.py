"""Unsupervised row scoring: isolation forest, reconstruction error, and their combination."""
