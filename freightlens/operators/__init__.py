"""Relational building blocks: filters, aggregates, unions, shaping, registry."""
