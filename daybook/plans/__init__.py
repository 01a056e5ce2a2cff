"""The library applied to concrete tables: sources, query catalogue and its SQL twins."""
