"""Operators of a training-data pipeline: dedup, fingerprints, scoring, tokens, mixing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
