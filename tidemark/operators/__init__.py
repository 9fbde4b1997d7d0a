"""Relational operators of the attribution, reporting, identity, spend and quality domains."""
