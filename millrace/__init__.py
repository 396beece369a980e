"""millrace: evidence analytics as composable DataFrame-to-DataFrame functions."""
