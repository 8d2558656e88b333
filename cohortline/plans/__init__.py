"""The whole study as one plan: cohort, features, review, comparison."""
