"""Operators for preparing training data, each as ``DataFrame -> DataFrame``.

Nothing outside this subpackage imports it.
"""
