"""Training-data operators: tokens, fingerprints, dedup, packing, media, archives, quality and secrets.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
