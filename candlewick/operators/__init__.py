"""Operators over candles: plain functions from DataFrame to DataFrame."""
