"""Relational operators over DataFrames: diff, match, align, cluster, pair, rank and measure."""
