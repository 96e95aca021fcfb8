"""Composite plans: driver-table role mapping, the registered query catalogue, report frames."""
