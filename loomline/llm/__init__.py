"""Training-data operators; nothing outside this subpackage (and corpus_pipeline.py) imports it."""
