"""Quality operators, each a ``DataFrame -> DataFrame`` function."""
