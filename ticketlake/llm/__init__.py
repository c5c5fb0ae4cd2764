"""Operators for preparing training data: texts, pages and vectors at corpus scale."""
