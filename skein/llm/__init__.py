"""Operators for preparing large text corpora; nothing else in skein imports this subpackage."""
