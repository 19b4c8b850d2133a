"""Operators for training-data corpora: filtering, deduplication, decontamination, mixing."""
