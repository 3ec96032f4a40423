"""Governance analytics for AI-agent data on Spark."""
