"""Composed plans: the fixture corpus, query catalog and oracle SQL."""
