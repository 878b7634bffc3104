"""Operators on tables of pages, links, rules and pairs."""
