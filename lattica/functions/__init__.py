"""Part of lattica; see the README for the module map."""
