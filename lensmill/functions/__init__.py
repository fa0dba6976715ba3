"""Functions of lensmill."""
