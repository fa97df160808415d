"""Thin adapters: command line, socket server, models, rate limits, the research loop."""
