"""Reusable distributed plans: sufficient statistics, global order, shared tables, tail probabilities."""
