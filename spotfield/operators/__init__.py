"""DataFrame-to-DataFrame operators, each keyed by ``specimen``."""
