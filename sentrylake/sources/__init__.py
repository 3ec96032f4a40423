"""Readers of logs, bundles, rules and prompts."""
