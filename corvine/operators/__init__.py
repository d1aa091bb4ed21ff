"""Relational operators: snapshot diff, maintenance, ranking, aggregation."""
