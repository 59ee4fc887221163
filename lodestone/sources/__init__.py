"""Readers and writers of rules, heuristics, manifests, sources and findings."""
