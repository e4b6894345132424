"""DataFrame operators.  Functions take and return DataFrames; the few that run
a small action (collecting a bounded table) say so in their docstring."""
