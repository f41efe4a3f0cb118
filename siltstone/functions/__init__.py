"""Part of the siltstone engine."""
