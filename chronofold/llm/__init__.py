"""Training-data operators: deduplication, filtering, extraction, sharding, packing, mixing.

Nothing outside this subpackage imports it; ``chronofold.llm.catalog`` lists its queries.
"""
