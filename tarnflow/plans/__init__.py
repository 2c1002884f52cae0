"""Whole pipelines, job lists, settings and command lines."""
