"""Training-data operators: deduplication, mixing, packing, tokens, language, media, sharding.

Nothing outside this folder imports it; the entry module registers its queries
only if it can be imported.
"""
