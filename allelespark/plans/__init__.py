"""Multi-operator dataflows and the query catalogue."""
