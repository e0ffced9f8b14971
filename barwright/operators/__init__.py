"""Operators on candle and result tables."""
