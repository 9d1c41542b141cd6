"""Operators for text and entity problems of training-data pipelines. Nothing else in the library imports this."""
