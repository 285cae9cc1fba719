"""Grouped model validation on Spark DataFrames.

Cases along a coordinate are clustered into loci, loci are dealt to
cross-validation folds, and configurations x replications x folds become rows
that are scored, measured and summarised with joins, windows and aggregates.
"""
