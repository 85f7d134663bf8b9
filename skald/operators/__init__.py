"""Relational operators over corpora, token tables and indexes."""
