"""Query catalogue of the engine's own operators over the test tables."""
