"""Sources of lensmill."""
