"""Relational operators over symbols, edges, sites and postings."""
