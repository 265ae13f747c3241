"""Tools around the codec: traces, grammar tables, tallies, and the command line."""
