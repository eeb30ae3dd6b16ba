"""Operators for preparing language-model training data.

A closed subpackage: nothing else in the library imports it. ``registry`` holds
its queries; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
