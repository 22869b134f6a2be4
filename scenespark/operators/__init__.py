"""Operators on DataFrames, by what they work on: scenes, calendars, joins, contrasts, tests, gates."""
