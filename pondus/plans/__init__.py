"""Composed jobs: survey bindings, the analysis frame, catalogue and request runs."""
