"""Relational, contextual, topological and graph operators over facts."""
