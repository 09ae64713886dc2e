"""Operators for preparing language-model training data.

Nothing outside this folder imports it; the driver contract adds its queries
only when it is present.
"""
