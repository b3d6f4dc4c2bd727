"""DataFrame-to-DataFrame operators; lazy unless a docstring says that a table is written."""
