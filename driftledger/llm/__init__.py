"""Operators for preparing training data at corpus scale."""
