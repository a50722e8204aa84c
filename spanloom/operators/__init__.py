"""DataFrame operators on events, intervals and fixed-rate series."""
