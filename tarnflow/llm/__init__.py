"""Operators for preparing large text and vector corpora for model training."""
