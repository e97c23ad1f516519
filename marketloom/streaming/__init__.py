"""Structured Streaming counterparts: snapshot feeds, closed bars, exits, decisions, daily P&L."""
