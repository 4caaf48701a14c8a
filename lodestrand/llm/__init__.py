"""Training-data operators: token files, deduplication, language and quality models,
packing, decontamination, vector search, language-model scoring and sharding.

Nothing outside this subpackage imports it.
"""
