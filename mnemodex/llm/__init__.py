"""Operators for training-data pipelines: near-duplicate search, filters,
classifiers, tokenizers, packing and exact top-k search, all as Spark jobs."""
