"""Jobs that run whole tasks over given tables: each a function that takes a session, and a command line with a config file."""
