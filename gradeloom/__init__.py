"""Curation, grading and evaluation analytics for question-answer datasets on Spark."""
