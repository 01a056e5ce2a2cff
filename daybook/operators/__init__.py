"""DataFrame-to-DataFrame operators over a panel keyed by ``(series_id, date)``."""
