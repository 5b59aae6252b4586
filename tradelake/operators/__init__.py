"""DataFrame -> DataFrame operators of the analytics engine."""
