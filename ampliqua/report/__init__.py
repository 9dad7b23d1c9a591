"""Report of the engine."""
