"""Relational operators over variant, score and genotype tables."""
