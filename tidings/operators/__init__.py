"""Operators on DataFrames: features, labels, clusters, fits, retention, exports."""
