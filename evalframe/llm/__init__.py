"""Operators for preparing large language-model training data.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
