"""Spark operators for question-answer corpora and feedback memories."""
