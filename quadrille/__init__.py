"""Quadrille: analytics over quads (subject, predicate, object, context) on Spark."""
