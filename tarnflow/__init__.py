"""A PySpark engine for ensembles of gridded hydro-climate runs, and for training-data preparation."""
