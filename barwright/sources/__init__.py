"""Candle tables: building, reading, upserting."""
