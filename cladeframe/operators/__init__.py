"""Relational operators over alignments, pairs, quartets and trees."""
