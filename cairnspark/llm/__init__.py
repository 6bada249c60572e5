"""Training-data operators: tokenising, quality, language, near copies, packing, secrets, shards, search.

Nothing outside this subpackage imports it. ``llm.queries`` registers one query for each operator.
"""
