"""Training-data operators: token counts, mixing, quality, dedup, language, chat, BPE, toxicity.

Nothing else in the library imports this subpackage.
"""
