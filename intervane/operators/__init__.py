"""DataFrame-to-DataFrame operators on fragments, cuts, intervals and tracks."""
