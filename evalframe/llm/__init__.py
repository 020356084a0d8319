"""Operators for training-data pipelines (see README, "Training-data operators").

Nothing else in the library imports this subpackage.
"""
