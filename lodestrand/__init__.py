"""Corpus preparation, training-row synthesis, retrieval, evaluation, stream guards and model
catalogues as Spark DataFrame transformations."""
