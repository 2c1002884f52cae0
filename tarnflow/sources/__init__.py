"""Readers, writers and discovery of model runs."""
