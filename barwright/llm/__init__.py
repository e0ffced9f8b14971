"""Operators for large training corpora: each one is a DataFrame-in, DataFrame-out function; nothing outside this folder imports it."""
