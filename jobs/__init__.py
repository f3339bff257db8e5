"""Runnable jobs over the library's operators. Each has a command line, a config file and a function that takes a session."""
