"""Cohort and longitudinal-event analytics as functions over Spark DataFrames."""
