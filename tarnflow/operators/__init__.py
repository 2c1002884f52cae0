"""Relational operators on grids, panels and ensembles."""
