"""Plans of lensmill."""
