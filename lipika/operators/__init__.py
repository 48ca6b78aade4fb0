"""Relational operators: dictionaries, vocabularies, mixing, scoring."""
