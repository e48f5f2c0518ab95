"""Joins, metrics, leaderboards, pair sets, mutations, splits and scoring over DataFrames."""
