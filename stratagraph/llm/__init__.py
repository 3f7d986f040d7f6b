"""Training-data operators: near-dedup, tokenising, chat, media, packing, sharding, quality, licences, token files.

Nothing else in the package imports this subpackage, so it can be removed whole.
"""
